"""Schemas of the index and of the documents it is read from."""

from __future__ import annotations

WORKS = "key STRING, ids ARRAY<STRING>, title STRING, authors ARRAY<STRING>, year STRING, msc ARRAY<STRING>, arxiv_category STRING, licence STRING, depth INT, reached_from ARRAY<STRING>, reached_by STRING, provenance STRING, citekeys ARRAY<STRING>"
WORK_IDS = "id STRING, work STRING"
VERSIONS = "id STRING, work STRING, has_source BOOLEAN, has_pdf BOOLEAN, method STRING, numbering STRING, extracted_at STRING"
RESULTS = "key STRING, version STRING, local STRING, taxon STRING, number STRING, title STRING, statement STRING, proof STRING, aliases ARRAY<STRING>, page STRING"
EDGES = "src STRING, dst STRING, origin STRING, confidence DOUBLE, evidence STRING"
REFS = "version STRING, work STRING, citekey STRING, text STRING, identified_by STRING"
SAME_AS = "lhs STRING, rhs STRING, confidence DOUBLE, evidence STRING"
TABLES = {"works": WORKS, "work_ids": WORK_IDS, "versions": VERSIONS, "results": RESULTS, "edges": EDGES, "refs": REFS, "same_as": SAME_AS}

#: Keys of the tables (the columns an upsert replaces by).
KEYS = {"works": ["key"], "work_ids": ["id"], "versions": ["id"], "results": ["key"], "edges": ["src", "dst", "origin"], "refs": ["version", "citekey", "text"], "same_as": ["lhs", "rhs"]}
#: Names the counts are reported under.
COUNTED = {"works": "works", "versions": "versions", "results": "results", "edges": "edges", "refs": "references", "same_as": "same_as"}

#: Closed vocabularies (fixed values).
PROVENANCES = ("declared", "resolved", "asserted")
METHODS = ("latex", "pdf", "manual")
ORIGINS = ("internal", "locator", "unspecified")
REACHED_BY = ("declared", "lookup", "index")
NUMBERINGS = ("compiled", "emulated")
