"""Licence recognition by sentence rules, in SQL functions alone.

Sentences are normalised and looked up among known licence sentences, also those that run over several lines of a
comment or a paragraph; the identifiers found in a document, in order, are matched against ordered rules, each a
sequence of identifiers.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Normalised sentences of well-known licence notices, and the rules over their identifiers.
SENTENCES: dict[str, str] = {
    "released under the mit license": "mit_notice",
    "licensed under the mit license": "mit_notice",
    "permission is hereby granted free of charge to any person obtaining a copy of this software": "mit_grant",
    "the above copyright notice and this permission notice shall be included in all copies": "mit_keep",
    "licensed under the apache license version 2.0": "apache2_notice",
    "you may not use this file except in compliance with the license": "apache2_use",
    "you may obtain a copy of the license at": "apache2_copy",
    "this work is licensed under the gnu general public license version 3": "gpl3_notice",
    "this work is licensed under the gnu general public license version 2": "gpl2_notice",
    "this program is free software": "gpl_free",
    "you can redistribute it and/or modify it under the terms of the gnu general public license version 3": "gpl3_terms",
    "you can redistribute it and/or modify it under the terms of the gnu general public license version 2": "gpl2_terms",
    "licensed under cc by-nc 4.0": "cc_by_nc_notice",
    "licensed under cc by 4.0": "cc_by_notice",
    "licensed under cc by-sa 4.0": "cc_by_sa_notice",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd_grant",
    "redistributions of source code must retain the above copyright notice": "bsd_source",
    "redistributions in binary form must reproduce the above copyright notice": "bsd_binary",
    "neither the name of the copyright holder nor the names of its contributors may be used": "bsd_names",
    "all rights reserved": "reserved",
    "this is free and unencumbered software released into the public domain": "unlicense_notice",
}
#: In order of precedence at the same place: licence, the identifiers that must follow each other, its kind.
RULES: list[tuple[str, tuple[str, ...], str]] = [
    ("MIT", ("mit_grant", "mit_keep"), "permissive"),
    ("BSD-3-Clause", ("bsd_grant", "bsd_source", "bsd_binary", "bsd_names"), "permissive"),
    ("BSD-2-Clause", ("bsd_grant", "bsd_source", "bsd_binary"), "permissive"),
    ("Apache-2.0", ("apache2_notice", "apache2_use", "apache2_copy"), "permissive"),
    ("GPL-3.0", ("gpl_free", "gpl3_terms"), "copyleft"),
    ("GPL-2.0", ("gpl_free", "gpl2_terms"), "copyleft"),
    ("MIT", ("mit_notice",), "permissive"),
    ("Apache-2.0", ("apache2_notice",), "permissive"),
    ("GPL-3.0", ("gpl3_notice",), "copyleft"),
    ("GPL-2.0", ("gpl2_notice",), "copyleft"),
    ("GPL-3.0", ("gpl3_terms",), "copyleft"),
    ("GPL-2.0", ("gpl2_terms",), "copyleft"),
    ("CC-BY-NC-4.0", ("cc_by_nc_notice",), "noncommercial"),
    ("CC-BY-SA-4.0", ("cc_by_sa_notice",), "copyleft"),
    ("CC-BY-4.0", ("cc_by_notice",), "permissive"),
    ("Unlicense", ("unlicense_notice",), "permissive"),
    ("Proprietary", ("reserved",), "proprietary"),
]
# The same of the texts and headers as their authors publish them, which fill several lines.
_GPL = "you can redistribute it and/or modify it under the terms of the gnu {} as published by the free software foundation"
_LATER = "either version {} of the license or at your option any later version"
_CC = {"": "BY", "-noncommercial": "BY-NC", "-sharealike": "BY-SA", "-noderivatives": "BY-ND", "-noncommercial-sharealike": "BY-NC-SA", "-noncommercial-noderivatives": "BY-NC-ND"}
TEXTS: dict[str, str] = {
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and/or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "mit_full",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit_keep",
    "the above copyright notice and this permission notice including the next paragraph shall be included in all copies or substantial portions of the software": "mit_keep",
    "permission to use copy modify and/or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc_full",
    "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc_full",
    "permission to use copy modify and/or distribute this software for any purpose with or without fee is hereby granted": "bsd0_full",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd_full",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "bsd_source",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution": "bsd_binary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd_names",
    "nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd_names",
    "licensed under the apache license version 2.0 the license": "apache2_full",
    "the asf licenses this file to you under the apache license version 2.0 the license": "apache2_full",
    "apache license version 2.0 january 2004": "apache2_title",
    "the contents of this file are subject to the mozilla public license version 1.1 the license": "mpl11_full",
    "this source code form is subject to the terms of the mozilla public license v": "mpl2_full",
    "mozilla public license version 2.0": "mpl2_title",
    "this library is free software": "gpl_free",
    "gnu general public license version 3 29 june 2007": "gpl3_title",
    "gnu general public license version 2 june 1991": "gpl2_title",
    "gnu affero general public license version 3 19 november 2007": "agpl3_title",
    "gnu lesser general public license version 3 29 june 2007": "lgpl3_title",
    "gnu lesser general public license version 2.1 february 1999": "lgpl21_title",
    _LATER.format("2"): "gpl_later2",
    _LATER.format("2.1"): "gpl_later21",
    _LATER.format("3"): "gpl_later3",
    "version 2 of the license": "gpl_only2",
    "version 3 of the license": "gpl_only3",
    _GPL.format("general public license"): "gpl_full",
    _GPL.format("lesser general public license"): "lgpl_full",
    _GPL.format("affero general public license"): "agpl_full",
    _GPL.format("general public license version 2"): "gpl2_full",
    _GPL.format("general public license version 3"): "gpl3_full",
    "you can redistribute it and/or modify it under the terms of the gnu general public license version 2 only as published by the free software foundation": "gpl2_full",
    _GPL.format("general public license") + " " + _LATER.format("2"): "gpl2_full",
    _GPL.format("general public license") + " " + _LATER.format("3"): "gpl3_full",
    _GPL.format("general public license") + " version 2 of the license": "gpl2_full",
    _GPL.format("general public license") + " version 3 of the license": "gpl3_full",
    _GPL.format("affero general public license") + " " + _LATER.format("3"): "agpl3_full",
    _GPL.format("affero general public license") + " version 3 of the license": "agpl3_full",
    _GPL.format("lesser general public license") + " " + _LATER.format("2.1"): "lgpl21_full",
    _GPL.format("lesser general public license") + " " + _LATER.format("3"): "lgpl3_full",
    **{f"this work is licensed under {a} creative commons attribution{n} 4.0 international license": f"cc_{k.lower()}_full" for n, k in _CC.items() for a in ("a", "the")},
    **{f"creative commons attribution{n} 4.0 international public license": f"cc_{k.lower()}_title" for n, k in _CC.items()},
    "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions": "zlib_full",
    "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third-parties to whom the software is furnished to do so all subject to the following": "bsl_full",
    "distributed under the boost software license version 1.0": "bsl_full",
    "boost software license - version 1.0 - august 17th 2003": "bsl_title",
    **{f"this program and the accompanying materials are made available under the terms of the eclipse public license {v}2.0 {x}": "epl_full" for v in ("", "v ", "v. ", "v", "version ") for x in ("which is available at", "which accompanies this distribution", "which is available at https://www.eclipse.org/legal/epl-2.0", "which is available at https://www.eclipse.org/legal/epl-2.0/", "which is available at http://www.eclipse.org/legal/epl-2.0")},
    "eclipse public license - v 2.0": "epl_title",
    "creative commons legal code cc0 1.0 universal": "cc0_title",
    "cc0 1.0 universal": "cc0_title",
}
_CC_KINDS = {"BY": "permissive", "BY-SA": "copyleft", "BY-ND": "noderivatives"}
_FULL: list[tuple[str, tuple[str, ...], str]] = [
    ("MIT", ("mit_full", "mit_keep"), "permissive"),
    ("MIT", ("mit_full",), "permissive"),
    ("ISC", ("isc_full",), "permissive"),
    ("0BSD", ("bsd0_full",), "permissive"),
    ("BSD-3-Clause", ("bsd_full", "bsd_source", "bsd_binary", "bsd_names"), "permissive"),
    ("BSD-2-Clause", ("bsd_full", "bsd_source", "bsd_binary"), "permissive"),
    ("Apache-2.0", ("apache2_full", "apache2_use", "apache2_copy"), "permissive"),
    ("Apache-2.0", ("apache2_full",), "permissive"),
    ("Apache-2.0", ("apache2_title",), "permissive"),
    ("MPL-1.1", ("mpl11_full", "apache2_use", "apache2_copy"), "copyleft"),
    ("MPL-1.1", ("mpl11_full",), "copyleft"),
    *[("MPL-2.0", (i,), "copyleft") for i in ("mpl2_full", "mpl2_title")],
    *[(f"{n}-{v}", (*free, f"{k}_full", f"gpl_{how}{v.removesuffix('.0').replace('.', '')}"), "copyleft") for free in (("gpl_free",), ()) for n, k, v in (("GPL", "gpl", "2.0"), ("GPL", "gpl", "3.0"), ("AGPL", "agpl", "3.0"), ("LGPL", "lgpl", "2.1"), ("LGPL", "lgpl", "3.0")) for how in ("later", "only") if how == "later" or v != "2.1"],
    *[(n, (*free, f"{k}_full"), "copyleft") for free in (("gpl_free",), ()) for n, k in (("GPL-2.0", "gpl2"), ("GPL-3.0", "gpl3"), ("AGPL-3.0", "agpl3"), ("LGPL-2.1", "lgpl21"), ("LGPL-3.0", "lgpl3"))],
    *[(n, (f"{k}_title",), "copyleft") for n, k in (("GPL-2.0", "gpl2"), ("GPL-3.0", "gpl3"), ("AGPL-3.0", "agpl3"), ("LGPL-2.1", "lgpl21"), ("LGPL-3.0", "lgpl3"))],
    *[(f"CC-{k}-4.0", (f"cc_{k.lower()}_{x}",), _CC_KINDS.get(k, "noncommercial")) for k in _CC.values() for x in ("full", "title")],
    ("CC0-1.0", ("cc0_title",), "permissive"),
    ("Zlib", ("zlib_full",), "permissive"),
    *[("BSL-1.0", (i,), "permissive") for i in ("bsl_full", "bsl_title")],
    *[("EPL-2.0", (i,), "copyleft") for i in ("epl_full", "epl_title")],
]
# Identifiers that files name in a tag, and their kinds.
SPDX: dict[str, str] = {
    "MIT": "permissive", "ISC": "permissive", "0BSD": "permissive", "BSD-2-Clause": "permissive", "BSD-3-Clause": "permissive", "Apache-2.0": "permissive",
    "Unlicense": "permissive", "Zlib": "permissive", "BSL-1.0": "permissive", "CC0-1.0": "permissive", "CC-BY-4.0": "permissive", "CC-BY-SA-4.0": "copyleft",
    "CC-BY-NC-4.0": "noncommercial", "CC-BY-ND-4.0": "noderivatives", "CC-BY-NC-SA-4.0": "noncommercial", "CC-BY-NC-ND-4.0": "noncommercial",
    "MPL-1.1": "copyleft", "MPL-2.0": "copyleft", "EPL-2.0": "copyleft", "GPL-2.0": "copyleft", "GPL-3.0": "copyleft", "LGPL-2.1": "copyleft", "LGPL-3.0": "copyleft",
    "AGPL-3.0": "copyleft",
}
_TAG = "spdx-license-identifier"
TAGS = {f"{_TAG} {name.lower()}{more}": f"spdx_{name.lower()}" for name in SPDX for more in (("", "-only", "-or-later", "+") if "GPL" in name else ("",))}
_FULL += [(name, (f"spdx_{name.lower()}",), kind) for name, kind in SPDX.items()]
#: Rules of these are tried before the others. A reservation of rights right before a licence belongs to its notice.
TEXT_RULES = [(name, (*own, *ids), kind) for own in (("reserved",), ()) for name, ids, kind in _FULL]
# Each pattern is tried once a run of like characters, is possessive and repeats no group, so that any text takes time as
# it is long; each begins with a character or class of its own, so that most places are passed at a glance.
#: What opens a comment line, and items of a list in it: marks up to white space or the line's end.
_LEADER = r"\n(?:[\x20\x09]*+(?:@?rem|dnl)(?=[\x20\x09]))?+[\x20\x09/*#;%+<>!-]*+(?:(?<=[\x20\x09\n])|(?=\n|\z))"
#: What closes a comment at a line's end.
_CLOSER = r"(?:\*(?<!\*\*)\**+/|-(?<!--)-++>)(?=[\x20\x09]*+(?:\n|\z))"
#: A sentence ends at . ; : ! ? before white space or the end, at an empty line, and may end at any line end.
_STOP = r"[.;:!?](?<![.;:!?]{2})[.;:!?]*+(?=[\x20\x09-\x0D]|\z)"
_SPACES = r"\x20(?=[\x20\x09\x0B\x0C])[\x20\x09\x0B\x0C]++|[\x09\x0B\x0C][\x20\x09\x0B\x0C]*+"
_KNOWN = SENTENCES | TEXTS | TAGS
_OWNER = r"(?<![^\x01\x02])neither[ \x02]the[ \x02]name[ \x02]of[ \x02][^\x01]{1,120}?[ \x02]nor[ \x02]the[ \x02]names[ \x02]of[ \x02]its"
#: A known sentence has at most so many words, so lines, and characters.
_WORDS, _CHARS = max(s.count(" ") + 1 for s in _KNOWN), max(map(len, _KNOWN))


def _let(value: Column, use) -> Column:
    """use(value), with the value made once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def normalised(docs: DataFrame, text: str) -> DataFrame:
    """docs with ``text`` as one line: A-Z in lower case, comment leaders, commas, quotes and brackets gone, runs of
    white space one space, \x01 where a sentence ends and \x02 where a line ends within what may be a sentence.
    """
    one = F.col(text)
    replaced = lambda out, *pairs: replaced(F.replace(out, F.lit(pairs[0][0]), F.lit(pairs[0][1])), *pairs[1:]) if pairs else out
    docs = docs.withColumn(text, replaced(F.coalesce(one, F.lit("")), ("\x01", "\x03"), ("\x02", "\x03"), ("\r\n", "\n"), ("\r", "\n")))
    # lower() knows two more letters that become ASCII ones: those texts take the long way.
    docs = docs.withColumn(text, F.when(F.contains(one, F.lit("K")) | F.contains(one, F.lit("İ")), F.translate(one, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise(F.lower(one)))
    # A tag is a sentence, and so is each licence of a tag that names up to four.
    tagged = F.regexp_replace(one, _TAG + r":[\x20\x09]*+\(?", _TAG + " ")
    for _ in range(3):
        tagged = F.regexp_replace(tagged, rf"({_TAG} [a-z0-9.+-]++)[\x20\x09]++(?:or|and)[\x20\x09]++(?=[a-z0-9])", f"$1\x01{_TAG} ")
    docs = docs.withColumn(text, F.when(F.contains(one, F.lit(_TAG + ":")), tagged).otherwise(one))
    docs = docs.withColumn(text, F.regexp_replace(F.concat(F.lit("\n"), one), _LEADER, "\n"))
    out = F.when(F.contains(one, F.lit("*/")) | F.contains(one, F.lit("-->")), F.regexp_replace(one, _CLOSER, "")).otherwise(one)
    out = replaced(F.regexp_replace(F.regexp_replace(out, _STOP, "\x01"), "[,\"'()]", ""), *((c, "") for c in "“”‘’"))
    docs = docs.withColumn(text, out)
    wide = [F.contains(one, F.lit(c)) for c in ("  ", "\t", "\x0b", "\x0c")]
    out = replaced(F.when(wide[0] | wide[1] | wide[2] | wide[3], F.regexp_replace(one, _SPACES, " ")).otherwise(one), (" \n", "\n"), ("\n ", "\n"), (" \x01", "\x01"), ("\x01 ", "\x01"))
    docs = docs.withColumn(text, F.trim(replaced(F.regexp_replace(out, r"\n\n++", "\x01"), ("\n", "\x02"))))
    # Sentences of BSD name the owner.
    return docs.withColumn(text, F.when(F.contains(one, F.lit("neither")), F.regexp_replace(one, _OWNER, "neither the name of the copyright holder nor the names of its")).otherwise(one))


def _begun() -> Column:
    """The known sentences that begin with one word or two, the longest first."""
    by: dict[str, list[str]] = {}
    for s in sorted(_KNOWN, key=lambda s: (-len(s), s)):
        for w in {" ".join(s.split(" ")[:n]) for n in (1, 2)}:
            by.setdefault(w, []).append(s)
    return F.create_map(*[x for w, own in by.items() for x in (F.lit(w), F.array(*[F.struct(F.lit(s).alias("s"), F.lit(_KNOWN[s]).alias("id")) for s in own]))])


def sentences(docs: DataFrame, text: str) -> DataFrame:
    """docs with ``text`` as the identifiers of its known sentences, in order. Between them other text may stand.

    The text is split where sentences or lines end. A piece is looked up by its first two words (all, if it has but
    one) among the known sentences, with the lines behind it if it ends with its line; the longest one that ends where
    a piece ends counts, and pieces that it takes begin no other.
    """
    begun = _begun()
    key = lambda p: F.substring_index(F.ltrim(p, F.lit("\x01")), " ", 2)
    docs = normalised(docs, text).withColumn(text, F.split(F.replace(F.col(text), F.lit("\x01"), F.lit("\x02\x01")), "\x02"))
    pieces, starts = F.col(text), "starts of " + text
    docs = docs.withColumn(starts, F.filter(F.transform(pieces, lambda p, i: F.when(F.map_contains_key(begun, key(p)), i)), lambda i: i.isNotNull()))

    def hit(i: Column) -> Column:
        # Pieces longer than any known sentence are cut: they can only fail. What a stop parts stays parted by it.
        cut = F.transform(F.slice(pieces, i + 1, _WORDS), lambda p: F.left(p, F.lit(_CHARS + 2)))
        lines = F.ltrim(F.array_join(cut, "\x02"), F.lit("\x01"))
        fits = lambda line: F.filter(F.try_element_at(begun, key(F.get(pieces, i))), lambda k: F.startswith(F.translate(line, "\x02", " "), k["s"]) & F.substring(line, F.length(k["s"]) + 1, F.lit(1)).isin("", "\x02"))
        used = lambda line, k: F.length(k["s"]) - F.length(F.replace(F.left(line, F.length(k["s"])), F.lit("\x02"), F.lit(""))) + 1
        named = lambda line: _let(F.get(fits(line), F.lit(0)), lambda k: F.when(k.isNotNull(), F.struct(i.alias("at"), (i + used(line, k)).alias("free"), k["id"].alias("id"))))
        return _let(lines, named)

    hits = F.filter(F.transform(starts, hit), lambda h: h.isNotNull())
    # A sentence of n lines can only hide those that begin in them.
    inside = lambda all_, h, n: F.exists(F.slice(all_, F.greatest(F.lit(1), n - _WORDS + 1), F.least(n, F.lit(_WORDS))), lambda other: (other["at"] < h["at"]) & (other["free"] > h["at"]))
    outer = lambda all_: F.when(F.exists(all_, lambda h: h["free"] > h["at"] + 1), F.filter(all_, lambda h, n: ~inside(all_, h, n))).otherwise(all_)
    found = _let(hits, lambda all_: F.transform(outer(all_), lambda h: h["id"]))
    return docs.withColumn(text, F.when(F.size(starts) > 0, found).otherwise(F.array().cast("array<string>"))).drop(starts)


def scan(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per document: doc_id, n_sentences (known ones), sentence_ids, licenses, license (the first), kind.

    Rules are tried in their order on the document's sequence of identifiers; a rule matches where its identifiers
    follow each other, and what it has matched counts for no later rule. licenses holds the licences matched, by
    place. SPDX tags are sentences too. Null or empty text and texts without known sentences: 0, empty lists, null licence and kind. Whole
    texts of any length are read. Repeated rows give repeated rows; null doc_id stays. Rows do not meet: no shuffle.
    """
    out = sentences(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("sentence_ids")), "sentence_ids").withColumn("n_sentences", F.size("sentence_ids").cast("long"))
    # Each identifier stands as " id "; a matched sequence becomes " #rule " and is out of reach of later rules.
    line = F.concat(F.lit(" "), F.array_join("sentence_ids", "  "), F.lit(" "))
    rules = TEXT_RULES + RULES
    for n, (_, ids_, _) in enumerate(rules):
        line = F.replace(line, F.lit(" " + "  ".join(ids_) + " "), F.lit(f" #{n} "))
    names = F.create_map(*[F.lit(x) for n, r in enumerate(rules) for x in (f"#{n}", r[0])])
    kinds = F.create_map(*[F.lit(x) for n, r in enumerate(rules) for x in (f"#{n}", r[2])])
    hits = F.filter(F.split(F.trim(line), " +"), lambda s: s.startswith("#"))
    out = out.withColumn("hits", F.when(F.col("n_sentences") > 0, hits).otherwise(F.array().cast("array<string>")))
    first = F.try_element_at("hits", F.lit(1))
    return out.select("doc_id", "n_sentences", F.array_join("sentence_ids", ",").alias("sentence_ids"), F.array_join(F.array_distinct(F.transform("hits", lambda h: names[h])), ",").alias("licenses"), names[first].alias("license"), kinds[first].alias("kind"))
