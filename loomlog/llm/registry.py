"""The queries of this subpackage, by name, and SQL for those that SQL can express."""

from __future__ import annotations

from . import chat, decontaminate, html_extract, minhash, packing, quality, secret_scan, substring_dedup, url_filter, warc

MODULES = (url_filter, packing, decontaminate, chat, html_extract, substring_dedup, secret_scan, minhash, quality, warc)
QUERIES = {name: f for m in MODULES for name, f in vars(m).items() if name.startswith("op") and name[2].isdigit()}
ORACLES = {name: sql for m in MODULES for name, sql in m.ORACLE.items()}
