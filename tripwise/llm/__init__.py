"""Training-data operators (deduplication, scoring, scans, formatting, mixing).

Nothing outside this subpackage imports it; `queries.py` lists its queries.
"""
