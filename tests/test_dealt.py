"""Work whose share per task does not grow with the tables."""

import re
from collections import Counter, defaultdict
from datetime import date, timedelta
from decimal import Decimal
from statistics import median

from ebbtide.operators import joins, mix, ordering
from ebbtide.plans.join_queries import keep_keys
from ebbtide.sources.tables import Tables

START = date(2024, 1, 7)


def plan(df):
    return df._jdf.queryExecution().toString()


def parts(df, key):
    """Numbers of partitions dealt by `key` first."""
    return {int(n) for n in re.findall(rf"hashpartitioning\({key}#\d+L?(?:, [^()]*)?, (\d+)\)", plan(df))}


def written(monkeypatch, *modules):
    """The frames that these modules settle, as they were before."""
    seen, settle = [], ordering.settle

    def keep(df):
        seen.append(df)
        return settle(df)

    for m in modules:
        monkeypatch.setattr(m, "settle", keep, raising=False)
    return seen


def test_keep_keys_has_tasks_of_fixed_size(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ordering, "TASK_ROWS", 20, raising=False)
    lines = [(1, p, d % (40 if p == 1 else 30)) for p in (1, 2, None) for d in range(60)] + [(1, 3, None), (1, 1, None)]
    rows = [(o, p, None if d is None else str(START + timedelta(d)), "A", "30000.00", "0.00") for o, p, d in lines]
    names = "l_orderkey int, l_partkey int, l_shipdate string, l_returnflag string, l_extendedprice string, l_discount string"
    spark.createDataFrame(rows, names).write.parquet(f"{tmp_path}/lineitem.parquet")
    got = keep_keys(Tables(spark, str(tmp_path)))
    assert parts(got, "product_id") == {6}  # 102 days of products, 4 shuffle partitions
    want = Counter((p, d) for _, p, d in lines if p == 1)
    assert {(r["product_id"], r["sale_date"] and (r["sale_date"] - START).days): int(r["net"]) for r in got.collect()} == {k: 30000 * n for k, n in want.items()}


def test_invoice_medians_have_tasks_of_fixed_size(spark, monkeypatch):
    monkeypatch.setattr(ordering, "TASK_ROWS", 10, raising=False)
    seen = written(monkeypatch, mix, ordering)
    lines = [(START + timedelta(i % 3), None if i % 11 == 0 else i % 17, Decimal(i * 7 % 23 - 4), i % 5) for i in range(200)] + [(None, 1, Decimal(3), 1), (START, 99, None, None)]
    tx = spark.createDataFrame(lines, "day date, invoice int, v decimal(18,4), q int")
    got = {r["day"]: r for r in mix.value_weighted_share(tx, "day", "invoice", "v", {"odd": "q % 2 = 1"}, "q").collect()}
    assert set(got) == {START + timedelta(i) for i in range(3)}
    for day, r in got.items():
        totals = defaultdict(list)
        for d, i, v, _ in lines:
            if d == day:
                totals[i].append(v)
        sums = [float(sum(x for x in v if x is not None)) for v in totals.values() if any(x is not None for x in v)]
        assert abs(r["avg_invoice"] - sum(sums) / len(sums)) < 1e-9 and r["median_invoice"] == median(sums)
        weight = [(max(v, 0), q % 2) for d, _, v, q in lines if d == day and v is not None]
        assert abs(r["odd"] - float(sum(w for w, odd in weight if odd) / sum(w for w, _ in weight))) < 1e-9
    assert {21} <= set().union(*(parts(f, "day") for f in seen))  # 202 lines, 4 shuffle partitions


def test_ranges_of_dealt_groups(spark, monkeypatch):
    monkeypatch.setattr(ordering, "TASK_ROWS", 50)
    monkeypatch.setattr(ordering, "GROUP_VALUES", 100)
    rows = [("a", float(i * 37 % 400)) for i in range(600)] + [("b", v) for v in (-0.0, 0.0, 1.0, None)] + [(None, 5.0), (None, 7.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r["g"]: r for r in ordering.exact_quantiles(df, "v", [0.5], ["g"], rows=606).collect()}
    want = {r["g"]: r for r in ordering.exact_quantiles(df, "v", [0.5], ["g"]).collect()}
    assert got == want and got["b"]["q50"] == 0.0 and got["a"]["q50"] == median(v for g, v in rows if g == "a")


def test_overlap_compares_neighbours_only(spark, monkeypatch):
    seen = written(monkeypatch, joins)
    days = [0, 0, 7, 14, 15, 22, 35, 42, 70, 77, 105]
    rows = [(g, START + timedelta(d), i) for g in ("a", None) for d in days for i in (*range(8), None) if (d * 3 + (i or 11) * 5) % 4] + [("a", None, 1)]
    d = spark.createDataFrame(rows, "g string, week date, item int")
    got = {(r["g"], r["week"]): tuple(r)[2:] for r in joins.set_overlap(d, ["g"], "week", "item").collect()}
    member, before = defaultdict(set), defaultdict(set)
    for g, w, i in rows:
        if w:
            member[g, w].add(i)
            for k in range(1, 5):
                before[g, w + timedelta(7 * k)].add(i)
    present = {w for _, w in member}
    want = {}
    for key in {*member, *before}:
        if key[1] in present:
            m, b = member[key], before[key]
            want[key] = (len(m), len(b), len(m & b), len(m - b), len(b - m))
    assert got == want
    # the copies of a membership are counted where they arise, not dealt by item
    tree = plan(seen[-1]).split("== Physical Plan ==")[1]
    assert tree.index("Generate") < tree.index("Window")
