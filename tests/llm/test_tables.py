"""Mixing, sharding and line dedup: against models, and on odd rows."""

import bisect
import collections
import hashlib
import random
import zlib

import pytest

from lodestore.llm import line_dedup, mixing, sharding

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string, __extra int"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), "own", 7) for i, t, s in rows], DOCS)


def odd(spark):
    return docs(spark, [(1, "a b c", "x"), (1, "a b c", "x"), (None, "a b", None), (None, None, "y"), (5, "", "x"), (6, "w " * 5000, "z"), (7, " \t\n", None)])


def level(sizes, weights, most=3):
    """Targets by sharing again and again."""
    total, left = sum(sizes), set(range(len(sizes)))
    got = [0.0] * len(sizes)
    while left:
        rest = total - sum(got[i] for i in range(len(sizes)) if i not in left)
        w = sum(weights[i] for i in left)
        over = {i for i in left if rest * weights[i] / w > most * sizes[i]}
        if not over:
            for i in left:
                got[i] = rest * weights[i] / w
            return got
        for i in over:
            got[i] = most * sizes[i]
        left -= over
    return got


@pytest.mark.parametrize("sizes", [[10], [1, 100, 5, 7], [1, 1, 1, 1000], [3, 50, 2, 9, 9, 400, 1]])
def test_targets_are_shared_until_none_is_above(spark, sizes):
    names = [f"s{i}" for i in range(len(sizes))]
    rows = mixing.targets(spark.createDataFrame(list(zip(names, sizes, strict=True)), "source string, source_size long")).collect()
    want = level(sizes, [1 + i % 3 for i in range(len(sizes))])
    assert {r["source"]: pytest.approx(r["target"]) for r in rows} == dict(zip(names, want, strict=True))


def test_mixing_keeps_rows_and_agrees_with_itself(spark):
    rows = odd(spark)
    one = sorted(map(str, mixing.plan(rows).select("doc_id", "size", "source_size", "target", "copies").collect()))
    assert one == sorted(map(str, mixing.plan(rows.repartition(3)).select("doc_id", "size", "source_size", "target", "copies").collect()))
    assert len(one) == 7
    plan = mixing.plan(rows).collect()
    assert all(r["copies"] <= 3 for r in plan) and all(r["copies"] == 0 for r in plan if r["source"] == "y")
    mixed = mixing.mix(rows)
    assert mixed.columns == rows.columns and mixed.count() == sum(r["copies"] for r in plan)
    assert {r["size"] for r in mixed.collect()} == {"own"}


def test_mixing_comes_near_its_targets(spark):
    rows = docs(spark, [(i, "w " * (5 + i % 7), f"s{i % 4}") for i in range(3000)])
    sums = collections.Counter()
    target = {}
    for r in mixing.plan(rows).collect():
        sums[r["source"]] += r["size"] * r["copies"]
        target[r["source"]] = r["target"]
    assert all(abs(sums[s] - t) < 0.1 * t for s, t in target.items())


def test_mixing_of_nothing(spark):
    assert mixing.plan(docs(spark, [])).count() == 0 and mixing.mix(docs(spark, [])).count() == 0


@pytest.mark.parametrize("n", [0, 1, 23, 500])
def test_shards_are_even_and_gapless(spark, n):
    rows = sharding.shard(docs(spark, [(i, f"t{i % 9}", "x") for i in range(n)])).collect()
    slots = collections.defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
        assert r["text_crc32"] == zlib.crc32(r["text"].encode()) and int(r["size"]) == len(r["text"]) + 8
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    counts = [len(slots.get(s, [])) for s in range(24)]
    assert sum(counts) == n and max(counts) - min(counts) <= 1


def test_shards_of_odd_rows(spark):
    rows = sharding.shard(odd(spark)).collect()
    assert len(rows) == 7 and {r["law"] for r in rows} == {"rows"} and {r["grown_shard"] for r in rows} == {None}


def test_flow_keeps_rows_at_home_while_there_is_room():
    owners = [0, 1, 0, 1]
    pieces = sharding.flow({0: 5, 1: 1, 2: 1, 3: 1}, owners, 2)
    assert sum(hi - lo for _, lo, hi, _, _ in pieces) == 8
    assert sum(hi - lo for arc, lo, hi, s, _ in pieces if s != owners[arc]) == 2


def walked(ids, shards, nodes=sharding.NODES):
    """Shards by a plain walk: rows by place; each takes the next node clockwise whose shard has room, those at home first."""
    points = sorted((int(hashlib.md5(f"{s}/{v}".encode()).hexdigest()[:13], 16), s) for s in range(shards) for v in range(nodes))
    at = {i: int(hashlib.md5(str(i).encode()).hexdigest()[:13], 16) for i in ids}
    arc = {i: bisect.bisect_left(points, (at[i], -1)) % len(points) for i in ids}
    room = [len(ids) // shards + (s < len(ids) % shards) for s in range(shards)]
    out, late = {}, []
    for i in sorted(ids, key=lambda i: (arc[i], at[i])):
        s = points[arc[i]][1]
        if room[s]:
            room[s] -= 1
            out[i] = s
        else:
            late.append(i)
    for i in late:
        k = arc[i]
        while not room[points[k][1]]:
            k = (k + 1) % len(points)
        out[i] = points[k][1]
        room[out[i]] -= 1
    return out


@pytest.mark.parametrize("n", [1, 50, 3000])
def test_shards_are_those_of_a_plain_walk(spark, n):
    ids = random.Random(n).sample(range(10**9), n)
    got = sharding.shard(docs(spark, [(i, f"t{i}", "x") for i in ids])).collect()
    assert {r["doc_id"]: r["shard"] for r in got} == walked(ids, 24)


def test_crowded_ranges_are_ranked_by_task(spark):
    rows = docs(spark, [(7 if i % 3 else i, f"t{i % 2}", "x") for i in range(900)]).repartition(5)
    got = sharding.shard(rows, crowded=100).collect()
    assert sorted(r["slot"] for r in got if r["shard"] == 3) == list(range(sum(r["shard"] == 3 for r in got)))
    counts = collections.Counter(r["shard"] for r in got)
    assert len(got) == 900 and max(counts.values()) - min(counts.values()) <= 1 and len({(r["shard"], r["slot"]) for r in got}) == 900


def test_few_rows_move_to_one_more_shard(spark):
    rows = docs(spark, [(i, f"t{i}", "x") for i in range(2000)])
    a = {r["doc_id"]: r["shard"] for r in sharding.shard(rows, 24).collect()}
    b = {r["doc_id"]: r["shard"] for r in sharding.shard(rows, 25).collect()}
    assert sum(a[i] != b[i] for i in a) <= 0.08 * 2000


def test_arcs(spark):
    points = [p for p, _ in sharding.ring(3, 16)]
    at = [0, points[0], points[0] + 1, points[5] - 1, points[-1], points[-1] + 1, (1 << 52) - 1]
    got = spark.createDataFrame([(a,) for a in at], "a long").select(sharding.arc_of(spark_col("a"), points).alias("arc")).collect()
    assert [r["arc"] for r in got] == [next((i for i, p in enumerate(points) if p >= a), 0) for a in at]


def spark_col(name):
    from pyspark.sql import functions as F

    return F.col(name)


def lines_model(rows, sites=5, copies=(), share=0.5):
    on, first = collections.defaultdict(set), {}
    for i, t, s in sorted(rows):
        for p, line in enumerate((t or "").split("\n")):
            if line.strip(" \t\n\v\f\r"):
                on[line].add(s)
                first.setdefault(line, (i, p))
    out = {}
    for i, t, s in rows:
        parts = (t or "").split("\n")
        gone = {p for p, line in enumerate(parts) if len(on[line]) >= sites and first[line] != (i, p)}
        words = sum(len(parts[p].split()) for p in gone)
        out[i] = t if not gone or (i in copies and words > share * len((t or "").split())) else "\n".join(x for p, x in enumerate(parts) if p not in gone)
    return out


def test_lines_of_many_sites_go(spark):
    rows = [(i, f"own line {i} with some words here\nshared boilerplate\n\nrare {i % 40}\nlast words of text {i}", f"s{i % 8}") for i in range(80)]
    rows += [(100 + i, "a copied text\nshared boilerplate", f"s{i}") for i in range(8)]
    got = line_dedup.dedup(docs(spark, rows))
    assert {r["doc_id"]: r["text"] for r in got.collect()} == lines_model(rows)
    assert all(r["n_chars"] == len(r["text"]) for r in got.collect())
    assert {r["text"] for r in got.where("doc_id > 100").collect()} == {""}
    known = spark.createDataFrame([(i,) for i in (100, 103, 103, 104, 7, None)], "doc_id long")
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup(docs(spark, rows), copies=known).collect()}
    assert got == lines_model(rows, copies={100, 103, 104, 7}) and got[103] == rows[83][1] and got[105] == ""


def test_near_threshold_lines_are_counted_exactly(spark):
    rows = [(i * 100 + s, f"unique words number {i} {s} go on and on\nline {i}", f"s{s}") for i in range(3, 9) for s in range(i)]
    got = {r["doc_id"]: r["n_removed"] for r in line_dedup.dedup(docs(spark, rows)).collect()}
    assert {i for i, n in got.items() if n} == {i * 100 + s for i in range(5, 9) for s in range(1, i)}


def test_line_dedup_of_odd_rows(spark):
    got = line_dedup.dedup(odd(spark))
    assert got.count() == 7 and line_dedup.dedup(docs(spark, [])).count() == 0
    assert sorted(str(r["text"]) for r in got.collect()) == sorted(str(r["text"]) for r in odd(spark).collect())
