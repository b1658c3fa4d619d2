"""The hand graph with its expected windows, and a random graph against brute force."""

import random

from citelode.operators import graph

# W1 (2020) references 2, 2, 3, 4, 5, 6, 999, 1
YEARS = {1: 2020, 2: 2018, 3: 2019, 4: 2020, 5: 2022, 6: None}
CITERS = [(10, 2020, [1]), (11, 2021, [2]), (12, 2022, [1, 2]), (13, 2023, [1]), (14, 2024, [2, 3]), (15, 2024, [1, 3]), (16, 2025, [1]), (17, 2026, [2])]


def frames(spark, works, refs):
    nodes = spark.createDataFrame(works, "work_id long, year int")
    return nodes, spark.createDataFrame(refs, "citing long, position int, cited long")


def brute(works, refs, snapshot):
    year = dict(works)
    out = {w: set() for w in year}
    for a, _, b in refs:
        if b is not None and b in year and a in year and a != b:
            out[a].add(b)
    rows = {}
    for f, fy in year.items():
        if fy is None:
            continue
        valid = {r for r in out[f] if year[r] is not None and year[r] < fy}
        for c, cy in year.items():
            if c == f or cy is None or not fy <= cy <= snapshot:
                continue
            direct, shared = f in out[c], bool(out[c] & valid)
            if direct or shared:
                k = rows.setdefault((f, cy - fy), [0, 0, 0])
                k[0 if direct and not shared else 1 if direct else 2] += 1
    return {k: tuple(v) for k, v in rows.items()}


def test_audit_of_hand_graph(spark):
    refs = [(1, i, c) for i, c in enumerate([2, 2, 3, 4, 5, 6, 999, 1])]
    nodes, r = frames(spark, list(YEARS.items()), refs)
    edges = graph.canonical_edges(r, nodes)
    row = graph.reference_audit(r, nodes, edges).first().asDict()
    want = {"raw": 8, "valid": 2, "resolved": 5, "duplicate": 1, "dangling": 1, "self_loop": 1, "same_year": 1, "future_year": 1, "unknown_year": 1, "invalid": 0}
    assert {k: row[k] for k in want} == want


def test_annual_counts_and_windows(spark):
    works = list(YEARS.items()) + [(i, y) for i, y, _ in CITERS]
    refs = [(1, i, c) for i, c in enumerate([2, 2, 3, 4, 5, 6, 999, 1])] + [(i, k, c) for i, _, cs in CITERS for k, c in enumerate(cs)]
    nodes, r = frames(spark, works, refs)
    edges = graph.canonical_edges(r, nodes)
    got = {(x["work_id"], x["age_year"]): (x["NF"], x["NB"], x["NR"]) for x in graph.annual(edges, 2026).collect()}
    assert got == brute(works, refs, 2026)
    focal = graph.focal_stats(nodes, graph.reference_audit(r, nodes, edges), edges)
    w = {(x["window_policy"], x["window"]): x for x in graph.windows(focal, graph.annual(edges, 2026), "2026-06-26").where("work_id = 1").collect()}
    three = w["exclude_publication_year", "3y"]
    assert (three["NF"], three["NB"], three["NR"]) == (1, 1, 1) and three["disruption_cd"] == 0 and three["is_mature"]
    ten = w["exclude_publication_year", "10y"]
    assert ten["disruption_cd"] is None and ten["disruption_cd_raw_observed"] is not None and not ten["is_mature"]
    life = w["include_publication_year", "lifetime"]
    assert life["is_mature"] is None and life["disruption_cd"] is not None and "snapshot_limited" in life["flags"]
    unknown = graph.windows(focal, graph.annual(edges, 2026), "2026-06-26").where("work_id = 6").first()
    assert unknown["NF"] is None and unknown["computation_status"] == "unavailable_publication_year"


def test_random_graph_against_brute_force(spark):
    rng = random.Random(42)
    works = [(i, rng.choice([None, 2010, 2019, 2020, 2025, 2026, 2030])) for i in range(1, 81)]
    refs = []
    for i, _ in works:
        if i % 13 == 0:
            continue
        targets = [rng.randint(1, 89) for _ in range(rng.randint(0, 12))]
        targets += [None] * (i % 11 == 0) + [i, 999, 999] * (i % 17 == 0)
        refs += [(i, k, t) for k, t in enumerate(targets)]
    nodes, r = frames(spark, works, refs)
    rows = graph.annual(graph.canonical_edges(r, nodes), 2026).collect()
    assert {(x["work_id"], x["age_year"]): (x["NF"], x["NB"], x["NR"]) for x in rows} == brute(works, refs, 2026)
    assert all(x["citation_count"] == x["NF"] + x["NB"] for x in rows)


def test_empty_graph(spark):
    nodes, r = frames(spark, [], [])
    assert graph.annual(graph.canonical_edges(r, nodes), 2026).count() == 0
