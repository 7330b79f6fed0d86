"""Resolution against a brute-force reading of its definition, and under skew."""

from __future__ import annotations

import random
from datetime import date, timedelta

from postlens.operators import resolve
from postlens.operators.components import connected_components

SCHEMA = (
    "seq long, source string, normalized_title string, company_name string, location string, posted_date date, "
    "source_job_id string, apply_url string, description string, description_hash string"
)
PLACES = ["Sydney", "Sydney NSW", "NSW Regional", "Melbourne VIC", "VIC", "Perth", "", None]


def rows(n: int, seed: int, hot: bool = False):
    rnd = random.Random(seed)
    out = []
    for seq in range(n):
        company = "acme" if hot and rnd.random() < 0.6 else f"firm {rnd.randrange(3)}"
        day = None if rnd.random() < 0.06 else date(2026, 1, 1) + timedelta(days=rnd.randrange(0, 400, 9))
        text = f"text {rnd.randrange(40)}"
        out.append((
            seq, rnd.choice(["official_ats", "seek", "jora", "other"]), rnd.choice(["qm", "qm full time", "qa officer 2"]), company,
            rnd.choice(PLACES if rnd.random() < 0.3 else PLACES[:6]), day, rnd.choice(["", None, f"j{rnd.randrange(60)}"]),
            f"u{rnd.randrange(80)}", text, text,
        ))
    return out


def brute(data):
    noise = {"full", "time"}
    core = lambda t: " ".join(w for w in t.split() if w not in noise and not w.isdigit())
    city = lambda p: (p or "").split(",")[0].strip().lower()
    first, groups = {}, {}
    for r in data:
        key = (r[2], r[3], r[4] or "", str(r[5] or ""), r[6] or r[7])
        first.setdefault(key, r)
        groups.setdefault(first[key][0], []).append(r)
    content, merged = {}, {}
    for rep, members in groups.items():
        r = members[0]
        owner = content.setdefault((r[9], r[2], r[3]), rep)
        merged.setdefault(owner, []).extend(members)
    reps = {rep: members[0] for rep, members in merged.items()}
    parent = {rep: rep for rep in reps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(reps)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = reps[a], reps[b]
            near = x[5] is None or y[5] is None or abs((x[5] - y[5]).days) <= 21
            ca, cb = city(x[4]), city(y[4])
            place = not ca or not cb or set(ca.split()) & set(cb.split())
            if x[3] == y[3] and core(x[2]) == core(y[2]) and near and place:
                p, q = find(a), find(b)
                parent[max(p, q)] = min(p, q)
    return {m[0]: find(rep) for rep, members in merged.items() for m in members}


def test_clusters_equal_brute_force(spark):
    for n, seed, hot in ((150, 1, False), (220, 2, True)):
        data = rows(n, seed, hot)
        df = spark.createDataFrame(data, SCHEMA)
        got = {r.seq: r.cluster for r in resolve.clusters(df, hot_rows=5).collect()}
        assert got == brute(data)


def test_order_of_partitions_does_not_matter(spark):
    data = rows(120, 3)
    one = spark.createDataFrame(data, SCHEMA).coalesce(1)
    many = spark.createDataFrame(random.Random(5).sample(data, len(data)), SCHEMA).repartition(7)
    assert sorted(map(tuple, resolve.clusters(one).collect())) == sorted(map(tuple, resolve.clusters(many).collect()))


def test_survivor_prefers_source_then_length(spark):
    base = ("qm", "acme", "Sydney", date(2026, 6, 1))
    data = [
        (0, "jora", *base, "a", "u0", "long long text", "h0"), (1, "seek", *base, "b", "u1", "x", "h1"),
        (2, "official_ats", *base, "c", "u2", "x", "h2"), (3, "official_ats", *base, "d", "u3", "longer", "h3"),
        (4, "seek", "other", "acme", "Sydney", None, "e", "u4", "x", "h4"),
    ]
    df = spark.createDataFrame(data, SCHEMA)
    got = {r.seq: (r.canonical, r.status) for r in resolve.deduplicate(df, hot_rows=1).collect()}
    assert got == {0: (3, "duplicate"), 1: (3, "duplicate"), 2: (3, "duplicate"), 3: (3, "new"), 4: (4, "new")}


def test_components_on_chain_and_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7)]
    got = {r.v: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[v] for v in range(41)} == {0} and {got[v] for v in range(100, 130)} == {100}


def test_match_links_plan_has_no_pairwise_join(spark):
    node = resolve.nodes(resolve.pass2(resolve.pass1(resolve.slim(spark.createDataFrame(rows(50, 4), SCHEMA)))))
    plan = resolve.match_links(node)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_components_with_hot_vertices_agree_with_union_find(spark):
    """A chain of stars, with every key of more than two rows salted."""
    from postlens.operators.components import connected_components

    edges = [(100 * s, 100 * s + i) for s in range(5) for i in range(1, 12)] + [(100 * s + 3, 100 * (s + 1)) for s in range(3)]
    edges += [(900, 901), (901, 900), (950, 950)]
    got = connected_components(spark.createDataFrame(edges, "a long, b long"), hot_rows=2).collect()
    want = {v: (0 if v < 400 else 400 if v < 500 else 900) for e in edges if e[0] != e[1] for v in e}
    assert {r.v: r.root for r in got} == want and len(got) == len(want)
