"""Every query of the library outside the llm subpackage, with its DuckDB SQL."""

from __future__ import annotations

from tallyspark.plans import assessing, files_io, layouts, ledger, merging, ordered, pages, parsing, reports, tagged
from tallyspark.plans.common import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "assessing", "files_io", "layouts", "ledger", "merging", "ordered", "pages", "parsing", "reports", "tagged"]
