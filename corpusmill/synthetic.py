"""A deterministic corpus of small source files, made from the table part alike in Spark and in DuckDB.

File n holds snippet n modulo their number, with $K for its key; every snippet shows some detectors something to
find and something to leave alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.sources.files import as_files, spread

#: (folder, extension, text)
SNIPPETS: list[tuple[str, str, str]] = [
    ("src/components", "tsx", "'use client'\nimport React from 'react'\nimport { useState, useMemo } from 'react'\nimport { db$K } from '../db/client'\n// Initialize the counter value\nconst counter = useState(0)\nexport function Widget$K() {\n  return <Image src=\"a.png\" />\n}\nconst cls = <div className=\"flex p-2 p-4 !mt-1 w-[13px]\" title=\"Hello big world\">Some nice text</div>\nexport const metadata = { a: 1 }\n"),
    ("src/api", "ts", "import { find$K, load } from '../db/models'\nimport { load } from '../db/models'\nimport './side'\nimport lodash from 'lodash'\n// TODO fix this later\n// TODO(#12) tracked\nexport async function handler$K(req: any, res: any) {\n  for (const id of req.ids) {\n    const row = await db.query(\"SELECT * FROM t WHERE id=\" + id)\n    total += `x${id}`\n  }\n  eval(\"1\")\n  return load(total)\n  res.end()\n}\nconst value = JSON.parse(text) as any\nconst other = value as unknown as string\n"),
    ("src/util", "ts", "import { helper } from './f$K'\nimport { odd } from './internal/part'\nimport { wide } from '../wide'\n// ========================\n/* Generated by a tool */\nexport function copy$K(a: string, b: number) {\n  return helper(a).concat(String(b)).trim()\n}\nexport function copyAgain$K(a: string, b: number) {\n  return helper(a).concat(String(b)).trim()\n}\nconst tmp = copy$K('repeated constant text', 1)\nconst password = \"supersecret$K\"\nlet unusedThing$K = 3\nfunction deep() {\n  if (a) {\n    for (;;) {\n      while (b) {\n        if (c) {\n          if (d) { go() }\n        }\n      }\n    }\n  }\n}\n"),
    ("src/app", "js", "const x = 1\nconst label = 'repeated constant text'\nconst name = \"single\"\nconst two = 'other quotes here'\nconst q = 1;\ntry {\n  run()\n} catch (e) {\n}\n\n\n\nconsole.log(name)   \nfunction go$K() {\n\treturn 1;\n  const late = 2\n}\nif (true) {\n  go$K()\n}\nimport { useRouter } from 'next/router'\nexport async function getServerSideProps() {}\nconst local = 'http://localhost:3000'\nconst url = \"https://api.service.net/v1\"\ndebugger;\n/* lint-ignore-start */\ndebugger;\n/* lint-ignore-end */\ndebugger; // lint-ignore-line\n"),
    ("tools", "py", "import os\nfrom sys import *\n\n# Set up the logger\ndef run$K(a, b=[]):\n    print(a)\n    try:\n        go()\n    except:\n        pass\n\ndef stub$K():\n    pass\n\nclass Empty$K:\n    pass\n\ndef _hidden(x: int) -> int:\n    global state\n    logger.info(f\"x {x}\")\n    return x\n"),
    ("cmd", "go", "package main\n\nimport \"fmt\"\n\nimport (\n\tio \"example.org/x/files\"\n\t\"os\"\n)\n\nfunc Exported$K(x interface{}) {\n\tfor i := 0; i < 3; i++ {\n\t\tdefer close(i)\n\t}\n\tgoto end\n}\n\n// Documented$K does it\nfunc Documented$K() {\n\tv, _ := load(\"a\")\n}\n"),
    ("crate", "rs", "fn main() {\n    let a = x.unwrap();\n    let b = y.expect(\"no\");\n    unsafe { go() }\n    // SAFETY: checked\n    unsafe { go() }\n    match a {\n        _ => todo!(),\n    }\n    let c = 5.clone();\n}\n\nenum Big$K {\n    Small,\n    Large(String, Vec<u8>, HashMap<String, u8>),\n}\n"),
    ("web", "html", "<html>\n<body>\n<img src=\"a.png\">\n<img src=\"b.png\" alt=\"b\">\n<center class=\"used-$K box\">x</center>\n<a id=\"top\" onclick=\"go()\">y</a>\n</body>\n</html>\n"),
    ("web", "css", ".used-$K { color: red; }\n.unused-$K {\n  color: red;\n  margin: 0 !important;\n  color: blue !important;\n}\n#top, #gone {\n  left: 1;\n}\n.box {\n  top: 0 !important;\n  left: 0 !important;\n}\n* {\n  margin: 0;\n}\n"),
    ("conf", "json", "{\n  \"a\": 1,\n  \"a\": 2,\n  \"b\": {\n\"c\": {\n\"d\": {\n\"e\": {\n\"f\": {\n\"g\": $K}}}}},\n  \"x\": 1, \"y\": 2,\n  \"z\": 1, \"w\": 2,\n  \"last\": [1, 2],\n}\n"),
    ("conf", "yaml", "base: &base$K\n  k: 1\n  k: 2\none: *base$K\ntwo: *base$K\n\n\n\nthree: *base$K\n\n\n\nfour: 4\n\tbad: 1\n"),
    ("docs", "md", "# Title $K\n\nTODO write more\n\nOld heading\n===========\n\n[empty](#)\n\n```\ncode\n```\n"),
    ("src/util", "ts", "import { b$K } from './c$K'\nexport const a$K = b$K + 1\nexport const shared = a$K\n\tconst mixed = 1\n  const spaced = 2\nconst long = \"aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa\"\nt('menu.open')\nt('menu.close')\n"),
    ("src/sums", "ts", "import { Price } from './prices'\nexport function alpha$K(items: Map<string, any>): Promise<any> {\n  let sum = 0\n  for (const item of items) {\n    sum += item.price\n    sum += item.tax // with tax\n    audit(item.name)\n  }\n  return sum\n}\n\nconst beta$K = async (things) => {\n  let sum = 0\n  for (const item of items) {\n    sum += item.price\n\n    sum += item.tax\n    audit(item.name)\n  }\n  return sum\n}\nconst big = 9007199254740993\nconst even = 100000000000000000\nconst part = 0.1234567890123456789\nconst pair = [one as unknown as Left, two as unknown as Right]\nlet price: Price\nfunction pick$K(flag) {\n  if (flag) {\n    log(flag)\n    return 1\n  } else {\n    return 2\n  }\n  done()\n}\ntry {\n  go()\n} catch (e) {\n\n  // nothing\n}\nconst late: Set<any> = 1 // lint-disable-line types/generic-any\n/* lint-disable ast-slop/generic-name, types/generic-any */\nconst tmp: Promise<any> = 2\n/* lint-enable */\nconst tmp = 3\nconst code = 'eval(1)'\nconst pattern = /eval(x)/\n"),
    ("web", "html", "<html lang=\"en\">\n<img src=\"a\"> <img src=\"b\" alt=\"b\"> <IMG src=\"c\">\n</html>\n"),
]


def _quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


#: Modules whose state and syntax run over lines: (folder, extension, text)
MODULES: list[tuple[str, str, str]] = [
    ("src/core", "ts", "export function load$K(id: string) {\n  try {\n    return read(id)\n  } catch (e) {\n    // nothing to do\n  }\n  try { go() } catch {\n  }\n  try {\n    go()\n  } catch (e) {\n    console.log(e)\n    throw e\n  }\n}\nconst a = value as any\nconsole.debug(a, \"console.log(x) as any\")\nconst n = x as unknown as number\nconst o = x as unknown as Shape\n"),
    ("src/core", "ts", "/*\n * eval(code) was used here\n * const b = x as any\n */\nconst doc = `\n  eval(code)\n  el.innerHTML = user + x\n`\neval(code$K)\nconst re = /[/*]eval(x)/\nconst s = 'it\\'s eval(z)' /* open\n eval(q)\n*/ + eval(w)\nel.innerHTML = user + x\n"),
    ("src/flow", "ts", "function a$K(x) {\n  if (x) return 1\n  if (!x) {\n    throw new Error('x')\n  }\n  return {\n    value: x,\n  }\n\n  // far below\n  cleanup(x)\n}\nfunction b(list) {\n  for (const i of list) {\n    list.forEach((y) => {\n      return y\n    })\n    continue\n\n    use(i)\n  }\n  throw new Error(\n    'long',\n  )\n  const dead = 1\n  function hoisted() {}\n}\nswitch (k) {\n  case 1:\n    break\n  case 2:\n    return 2;\n    lost()\n  default:\n    done()\n}\ntry { go() } finally {\n  return 1\n  spared()\n}\n"),
    ("src/data", "ts", "const one$K = () => {\n  const row = prisma.user.find() as any\n  return row\n}\nfunction two(text) {\n  return JSON.parse(text) as any\n}\nfunction three(text) {\n  const f = (x) => x as any\n  return text as any\n}\nclass Four {\n  five(a = { b: 1 }, c) {\n    return\n    a.b\n  }\n}\nconst t = `${ (() => { return 1; more() })() } ${'}'} console.log(1)`\n"),
    ("tests", "ts", "console.log('in a test $K')\nconst x = y / 2 / 3\nconst z = `a ${`b ${c}`} d`\nlabel: for (;;) {\n  if (z) { break label }\n  else { continue }\n}\nreturn\nfoo()\n"),
]


#: Files that show rules which the others leave alone: (folder, extension, text)
ODD: list[tuple[str, str, str]] = [
    ("src/odd", "ts", "// the user account balance\nconst balance = user.account.balance\nexport class Box {\n  take(name: string) {\n    if (typeof name === 'string') { use(name, $K) }\n  }\n}\ninterface Shape { area(): number }\nclass Square implements Shape { }\n"),
    ("src/odd", "ts", "const row$K = prisma.user as any\n"),
    ("src/odd", "ts", "const w$K = window as any\n"),
    ("src/odd", "ts", "function g$K(eventOf: any) { return eventOf as any }\n"),
    ("src/odd", "ts", "const v$K = q as any\n"),
    ("src/odd", "ts", "function soon$K(a) {\n  // TODO implement\n  return null\n}\n"),
    ("src/odd", "ts", "".join(f"export const e{i} = {i}\n" for i in range(6)) + "use(1)\n" * 300),
    ("src/odd", "ts", "one($K)\r\ntwo()\r\n"),
    ("src/odd", "ts", "one($K)\r\ntwo()\nthree()\n"),
    ("src/odd", "ts", "one($K)\ntw\ufeffo()\n"),
    ("src/odd", "tsx", "'use client'\nexport const x$K = 1\n"),
    ("src/odd", "tsx", "export const B$K = () => <button onClick={f}>x</button>\n"),
    ("src/odd", "tsx", "export const L = () => <Link href=\"/a\"></Link>\n"),
    ("src/odd", "ts", "const a = \"\\d\"\nconst b = \"\\q\"\nconst c = /[\\.]/\n"),
    ("src/odd", "ts", "switch (k) {\n  case 1:\n    break;\n    lost();\n  default:\n    done();\n  case 2:\n    more();\n}\n"),
    ("cmd/odd", "go", "package main\nfunc init() {\n\thttp.Get(u)\n}\nfunc Load$K(id string) {\n\tdb.Query(id)\n}\nfunc CloneThing(t *Thing) *Thing {\n\treturn t\n}\n"),
    ("src/merge", "ts", "function deepMerge(a, b) {\n  for (const k in b) { a[k] = deepMerge(a[k], b[k]) }\n  return a\n}\nfunction mergeDeep(a, b) {\n  for (const k of Object.keys(b)) {\n    a[k] = mergeDeep(a[k], b[k])\n  }\n}\nconst c$K = deepMerge({}, input)\nconst s = 'deepMerge(x)' // deepMerge(y)\n"),
    ("src/merge", "ts", "import { deepMerge } from '../utils/deep-merge'\nconst d$K = deepMerge({}, x)\nconst mergeDeep = function (a, b) {\n  return { ...a, ...b }\n}\n"),
    ("tools/odd", "py", "def plain$K(a, b: int = 3, *rest, c=(1, 2), **more):\n    return f(a, [b,\n        c])\nclass T:\n    async def wrapped(\n        self,\n        first: dict[str, int] = {},  # one, two\n        second=\"x, (y\",\n        third: Callable[[int, str], bool] = None,\n        /,\n        *,\n        fourth=[],\n    ) -> tuple[int, str]:\n        pass\n    def none(self): pass\n"),
]


def files(spark: SparkSession, sf_dir: str, snippets: list[tuple[str, str, str]] = SNIPPETS) -> DataFrame:
    key = F.col("p_partkey").cast("string")
    at = (F.col("p_partkey") % len(snippets) + 1).cast("int")
    pick = lambda i: F.element_at(F.array(*[F.lit(s[i]) for s in snippets]), at)
    part = spread(spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey"), "p_partkey")
    return as_files(part, F.concat(pick(0), F.lit("/f"), key, F.lit("."), pick(1)), F.replace(pick(2), F.lit("$K"), key))


def sql(snippets: list[tuple[str, str, str]] = SNIPPETS) -> str:
    """The CTEs files(path, ext, lang, content) and lines(path, lang, num, text)."""
    from corpusmill.model import EXTENSIONS

    pick = lambda i: "[" + ", ".join(_quote(s[i]) for s in snippets) + f"][(p_partkey % {len(snippets)} + 1)::INT]"
    langs = "CASE ext " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in EXTENSIONS.items()) + " END"
    return f"""raw AS (SELECT {pick(0)} || '/f' || p_partkey || '.' || {pick(1)} AS path, {pick(1)} AS ext, replace({pick(2)}, '$K', p_partkey::VARCHAR) AS content FROM part),
files AS (SELECT path, ext, {langs} AS lang, content FROM raw),
lines AS (SELECT path, lang, unnest(string_split(content, chr(10))) AS text, unnest(range(1, len(string_split(content, chr(10))) + 1)) AS num FROM files)"""
