"""All registered queries of the core and their SQL."""

from __future__ import annotations

from scriptorium import correction, problems

QUERIES = {**correction.QUERIES, **problems.QUERIES}
SQL = {**correction.SQL, **problems.SQL}
