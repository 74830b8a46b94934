"""Plan-level helpers: scratch tables, pipelines and scoring plans."""
