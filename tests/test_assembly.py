"""Assembled bills against brute force, over every order."""

import collections

import duckdb

from claimweave.plans import registry
from claimweave.sources import testdata as td

SF = "/root/testdata/sf0.001"


def bills(folder):
    """Of each order: pages, rows as printed, rows after the fold, and the sums in hundredths."""
    con = duckdb.connect()
    for name in ("lineitem", "part", "orders"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    pages = collections.defaultdict(lambda: collections.defaultdict(list))
    for doc, page, description, amount in con.execute(f"WITH {td.ITEMS_SQL} SELECT doc_id, page_index, description, amt FROM items ORDER BY doc_id, line_index").fetchall():
        pages[doc][page].append((description, amount))
    stated = dict(con.execute(f"WITH {td.ITEMS_SQL} SELECT doc_id, stated FROM claims").fetchall())
    out = {}
    for doc, of in pages.items():
        own = [of[p] for p in sorted(of)]
        printed = [(own[i - 1][-1:] if i and doc % 8 == 0 else []) + rows for i, rows in enumerate(own)]
        merged = []
        for rows in printed:
            most = max((k for k in (1, 2, 3) if k <= min(len(merged), len(rows)) and merged[-k:] == rows[:k]), default=0)
            merged += rows[most:]
        gross = sum(a for _, a in merged) - stated[doc] if 7 in of else None
        net = (1000 if doc % 2 == 0 else 0) if 7 in of else None
        out[doc] = (len(own), sum(map(len, printed)), len(merged)), (gross, net, gross is None or (abs(gross) <= 100 and net <= 100))
    return out


def test_reconcile_every_order(spark):
    want = {k: v[1] for k, v in bills(SF).items()}
    got = [tuple(r[c] for c in ("doc_id", "gross_delta", "net_delta", "balanced")) for r in registry.queries()["reconcile_totals"](spark, SF).collect()]
    assert any(k % 8 == 0 for k in want) and sorted(got) == sorted((k, *v) for k, v in want.items())


def test_own_lines_repeat_over_a_break(spark, tmp_path):
    """Orders with up to five equal lines in a row over page breaks, reprinted and not, are returned like all others."""
    con = duckdb.connect()
    con.execute(f"CREATE TABLE l AS SELECT * FROM '{SF}/lineitem.parquet'")
    first = "(SELECT {0} FROM l f WHERE f.l_orderkey = l.l_orderkey AND f.l_linenumber = 1 ORDER BY f.l_partkey, f.l_suppkey, f.l_extendedprice LIMIT 1)"
    same = ", ".join(f"coalesce({first.format(c)}, {c}) AS {c}" for c in ("l_partkey", "l_extendedprice"))
    con.execute(f"COPY (SELECT * REPLACE ({same}) FROM l WHERE l_orderkey % 3 = 0 AND l_linenumber <= 1 + l_orderkey % 5 UNION ALL BY NAME SELECT * FROM l WHERE l_orderkey % 3 <> 0 OR l_linenumber > 1 + l_orderkey % 5) TO '{tmp_path}/lineitem.parquet'")
    for name in ("part", "orders"):
        con.execute(f"COPY (SELECT * FROM '{SF}/{name}.parquet') TO '{tmp_path}/{name}.parquet'")
    want = bills(tmp_path)
    twins = {k for k, ((_, printed, left), _) in want.items() if left < (printed if k % 8 else printed - want[k][0][0] + 1)}
    assert len(twins) > 50 and any(k % 8 == 0 for k in twins) and len(want) == len(bills(SF))
    pages = [tuple(r[c] for c in ("doc_id", "n_pages", "n_rows_raw", "n_rows")) for r in registry.queries()["page_assembly"](spark, str(tmp_path)).collect()]
    assert sorted(pages) == sorted((k, *v[0]) for k, v in want.items())
    totals = [tuple(r[c] for c in ("doc_id", "gross_delta", "net_delta", "balanced")) for r in registry.queries()["reconcile_totals"](spark, str(tmp_path)).collect()]
    assert sorted(totals, key=repr) == sorted(((k, *v[1]) for k, v in want.items()), key=repr)
