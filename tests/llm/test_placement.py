import collections
import datetime
import hashlib
import itertools
import math
import re
import zlib

import pytest
import xxhash
from pyspark.sql import functions as F

from fernweave.llm import mixing as X, sharding as S, syncmers as Y, url_filter as U
from fernweave.llm.queries import QUERIES
from fernweave.llm.running import hash_place, with_running_totals


def test_hilbert_curve_visits_every_cell_once_and_by_neighbours(spark):
    for bits in (1, 2, 3):
        n = 1 << bits
        cells = spark.createDataFrame(list(itertools.product(range(n), repeat=3)), "x int, y int, z int")
        got = {r.h: (r.x, r.y, r.z) for r in cells.select("*", S.hilbert_index(F.col("x"), F.col("y"), F.col("z"), bits).alias("h")).collect()}
        assert sorted(got) == list(range(n**3))
        assert all(sum(abs(a - b) for a, b in zip(got[i], got[i + 1], strict=True)) == 1 for i in range(n**3 - 1))


def size(text):
    return len((text or "").encode()) + 1


def slots_are_gapless(found):
    by = {}
    for r in found:
        by.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    return by


@pytest.mark.parametrize("law", ["rows", "bytes"])
def test_shards(docs, rows, none, law):
    found = S.hilbert_shards(docs, 3, law).collect()
    assert sorted((r.doc_id or -1, r["size"]) for r in found) == sorted((i or -1, size(t)) for i, t, *_ in rows)
    by = slots_are_gapless(found)
    if law == "rows":
        assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    order = [r.curve for r in sorted(found, key=lambda r: (r.shard, r.slot))]
    assert order == sorted(order)
    assert {"text", "lang", "key"} <= set(found[0].asDict()) and S.hilbert_shards(none, 3, law).collect() == []
    with pytest.raises(ValueError):
        S.hilbert_shards(docs, 3, "key")


def test_sharding_of_documents(spark, sf):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    found = QUERIES["op3_sharding"](spark, sf).collect()
    assert len(found) == len(docs)
    for r in found:
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (size(docs[r.doc_id].text), zlib.crc32((docs[r.doc_id].text or "").encode()), "rows", None)
    by = slots_are_gapless(found)
    order = [r.curve for r in sorted(found, key=lambda r: (r.shard, r.slot))]
    assert order == sorted(order) and len(set(order)) > 8  # shards are runs of the curve
    cell = {}
    for r in found:
        d = docs[r.doc_id]
        cell.setdefault((d.source, d.lang, int(math.floor(math.log2(r["size"]) * S.STEPS))), set()).add(r.curve)
    assert all(len(x) == 1 for x in cell.values())
    assert sorted(by) == list(range(8)) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    again = S.hilbert_shards(spark.read.parquet(f"{sf}/documents.parquet").repartition(7), 8, "rows").select("doc_id", "shard", "slot").collect()
    assert {(r.doc_id, r.shard, r.slot) for r in again} == {(r.doc_id, r.shard, r.slot) for r in found}


def quantile_cells(values, bits):
    """The cell of each value, by hand."""
    out, before = {}, 0
    for v in sorted(set(values), key=lambda v: (v is not None, v)):
        n = sum(x == v for x in values)
        out[v] = min((1 << bits) - 1, int((before + n / 2) * (1 << bits) / len(values)))
        before += n
    return out


def test_cells_are_quantiles_of_ordered_values(spark, monkeypatch):
    rows = [(s, lang, size) for i, s in enumerate(["a", "b", None, "ä", "漢", "zz", "b"]) for lang in ("en", None) for size in range(i + 1)]
    df = spark.createDataFrame(rows, "source string, lang string, step int")
    curve = {r.h: (r.x, r.y, r.z) for r in spark.createDataFrame(list(itertools.product(range(8), repeat=3)), "x int, y int, z int").select("*", S.hilbert_index(F.col("x"), F.col("y"), F.col("z"), 3).alias("h")).collect()}
    by = [quantile_cells([r[k] for r in rows], 3) for k in range(3)]
    for r in S.curve_places(df, 3).collect():
        assert curve[r.curve] == (by[0][r.source], by[1][r.lang], by[2][r.step])
    monkeypatch.setattr(S, "VALUES", 2)  # ranked by leading bytes
    some = {r.source: curve[r.curve][0] for r in S.curve_places(df, 3).collect()}
    assert some[None] <= some["a"] <= some["b"] <= some["zz"] <= some["ä"] <= some["漢"]


def test_filters_on_every_dimension_prune_shards(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    shards = S.hilbert_shards(docs, 32).select("source", "lang", "size", "shard").collect()
    quarter = sorted(r["size"] for r in shards)[:: len(shards) // 4]
    for dim in (lambda r: r.source, lambda r: r.lang, lambda r: sum(r["size"] >= q for q in quarter)):
        along, dealt = {}, {}
        for i, r in enumerate(shards):
            along.setdefault(dim(r), set()).add(r.shard)
            dealt.setdefault(dim(r), set()).add(xxhash.xxh64_intdigest(str(i)) % 32)
        assert sum(map(len, along.values())) < 0.8 * sum(map(len, dealt.values()))


def test_written_shards_prune(spark, docs, tmp_path):
    S.write_shards(S.hilbert_shards(docs, 3).select("doc_id", "shard", "slot"), f"file://{tmp_path}/out")
    back = spark.read.parquet(f"file://{tmp_path}/out")
    assert back.where("shard = 1").count() == len(docs.collect()) // 3 and back.count() == docs.count()


def test_running_totals_of_a_hot_group(spark):
    df = spark.range(3000).select((F.col("id") % 10 == 0).cast("int").alias("g"), "id", (F.col("id") % 7).alias("v")).withColumn("place", hash_place(F.col("id")))
    found = with_running_totals(df, ["g"], "place", {"v": "before"}, parts=16).collect()
    for g in (0, 1):
        total = 0
        for r in sorted((r for r in found if r.g == g), key=lambda r: r.place):
            assert r.before == total
            total += r.v


def solved(tokens, most):
    """The exponent by plain bisection."""
    p = [t / sum(tokens) for t in tokens]
    over = lambda a: max(x ** (a - 1) for x in p) / sum(x**a for x in p)
    if over(0) <= most:
        return 0.0
    if over(1) > most:
        return 1.0
    low, high = 0.0, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (low, mid) if over(mid) <= most else (mid, high)
    return high


def test_exponents(spark):
    tokens = [1, 40, 400, 7000, 30]
    sums = spark.createDataFrame(list(zip("abcde", tokens, strict=True)), "_source string, tokens long")
    for most in (1.05, 1.5, 4.0, 10_000.0):
        assert abs(X.solve(sums, max_repeat=most).exponent - solved(tokens, most)) < 2e-6
    p = [t / sum(tokens) for t in tokens]
    for wanted in (0.3, 0.9, 1.5):
        a = X.solve(sums, entropy=wanted).exponent
        w = [x**a / sum(y**a for y in p) for x in p]
        assert abs(-sum(x * math.log(x) for x in w) - wanted) < 1e-4 or a == 1.0
    assert X.solve(sums.limit(0), max_repeat=1.5).tokens == 0
    with pytest.raises(ValueError):
        X.solve(sums)


def test_mix_reads_its_quota(docs, rows, none):
    found = X.mix_sources(docs, max_repeat=2.0, block_tokens=64).collect()
    by = {}
    for r in found:
        by.setdefault(r.source, []).append(r)
    total = sum(r.n_tokens for r in {(x.doc_id, x.source, x.place): x for x in found if x.epoch == 0}.values())
    assert set(by) == {r[3] for r in rows} and total > 0
    for own in by.values():
        assert len({r.weight for r in own}) == 1
        own.sort(key=lambda r: (r.epoch, r.place))
        assert [r.block for r in own] == sorted(r.block for r in own)
    assert X.mix_sources(none).collect() == []
    drawn = X.draw(docs, max_repeat=2.0)
    assert drawn.columns == docs.columns and drawn.count() == len(found)


def test_quotas_and_ties_by_hand(spark):
    """Ids repeat and are missing: which rows are read up to the quota is fixed all the same."""
    rows = [(i % 5 if i % 3 else None, "ab"[i % 7 == 0], " ".join(["w"] * (i % 11)), i) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, n int")
    runs = [sorted(map(str, X.mix_sources(d, max_repeat=1.3, block_tokens=50).collect())) for d in (df.repartition(5), df.coalesce(1).orderBy(F.desc("n")))]
    assert runs[0] == runs[1]
    found = X.mix_sources(df, max_repeat=1.3, block_tokens=50).collect()
    total = {s: sum(r[3] % 11 + 1 for r in rows if r[1] == s) for s in "ab"}
    for s in "ab":
        own = [r for r in found if r.source == s]
        weight = {r.weight for r in own}.pop()
        quota, left = math.floor(weight * sum(total.values())), 0
        for epoch in sorted({r.epoch for r in own}):
            each = [r for r in own if r.epoch == epoch]
            if epoch < max(r.epoch for r in own):
                assert sum(r.n_tokens for r in each) == total[s]
            left += sum(r.n_tokens for r in each)
        assert quota <= left < quota + 11  # the last row read begins before the quota


@pytest.mark.parametrize(("limit", "mosts"), [(100_000, (1.1, 2.6)), (0, (1.3,))])
def test_draw_reads_what_the_mix_reads_and_shuffles_no_text(spark, monkeypatch, limit, mosts):
    """Equal rows, of which the last epoch may read some, included; also with salted sources."""
    monkeypatch.setattr(X, "BROADCAST_SOURCES", limit)
    rows = [(i % 5 if i % 3 else None, "abc"[i % 7 % 3], " ".join(["w"] * (i % 4)), i % 2) for i in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, n int").repartition(5)
    for most in mosts:
        drawn = X.draw(df, max_repeat=most)
        assert sorted(map(str, drawn.collect())) == sorted(map(str, X.mix_sources(df, max_repeat=most).select(*df.columns).collect()))
    if limit:
        plan = drawn._jdf.queryExecution().sparkPlan().toString()
        assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan


def test_no_source_is_read_more_often_than_allowed(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    most = 1.25
    found = X.mix_sources(docs, max_repeat=most).groupBy("source", "doc_id").count().groupBy("source").agg(F.max("count").alias("m"), F.avg("count").alias("a")).collect()
    assert all(r.m <= math.ceil(most) for r in found)




def chained(values, seed=42):
    """Spark's 64-bit hash of several values: each one's hash is the next one's seed."""
    for v in values:
        seed = xxhash.xxh64_intdigest(v.encode() if isinstance(v, str) else v.to_bytes(8, "little"), seed)
    return seed


def plain_anchors(text):
    """(position, hash) of the closed syncmers, one by one."""
    w = re.findall(r"[^\x20\x09-\x0D]{1,24}", text or "")
    if len(w) < Y.K:
        return [(0, chained([chained(w)]) & Y._MASK)] if w else []
    mers = [chained(w[i : i + Y.S]) for i in range(len(w) - Y.S + 1)]
    signed = [x - (1 << 64) if x >> 63 else x for x in mers]
    inner, out = Y.K - Y.S + 1, []
    for i in range(len(w) - Y.K + 1):
        own = signed[i : i + inner]
        if min(own) in (own[0], own[-1]):
            out.append((i, chained([mers[i], mers[i + 2], mers[i + 3]]) & Y._MASK))
    return out or [(0, chained(mers) & Y._MASK)]


def plain_text(found):
    return "".join(f"{h:08x}{p - q:x}" for (p, h), q in zip(found, [0, *(p for p, _ in found)], strict=False))


def plain_likeness(a, b):
    """By the definition: votes of first and last anchors of a hash, then all that match there."""
    if not a and not b:
        return 1.0
    places = [collections.defaultdict(list) for _ in range(2)]
    for held, side in zip(places, (a, b), strict=True):
        for p, h in side:
            held[h].append(p)
    votes = collections.Counter(end(places[1][h]) - end(places[0][h]) for h in places[0].keys() & places[1].keys() for end in (min, max))
    ours, theirs = set(), set()
    for o, _ in sorted(votes.items(), key=lambda x: (-x[1], x[0]))[: Y.OFFSETS]:
        same = {(p, h) for p, h in a if (p + o, h) in set(b)}
        if len(same) >= (1 if min(len(a), len(b)) == 1 else 2):
            ours |= same
            theirs |= {(p + o, h) for p, h in same}
    m = min(len(ours), len(theirs))
    return m / (len(a) + len(b) - m)


def test_repeated_lines_inside_a_longer_text(spark):
    """A is one line 50 times, B other words and then all of A; and the same without repetition."""
    line, other = " ".join(f"l{i}" for i in range(20)), " ".join(f"o{i}" for i in range(1500))
    repeated, single = " ".join([line] * 50), " ".join(f"s{i}" for i in range(1000))
    pairs = [(x, f"{other} {x}") for x in (repeated, single)] + [(repeated, f"{repeated} {line}"), ("a " * 90, "a " * 99)]
    got = [r.x for r in spark.createDataFrame(pairs, "a string, b string").coalesce(1).select(Y.likeness(Y.anchors(F.col("a")), Y.anchors(F.col("b"))).alias("x")).collect()]
    assert got[0] > 0.35 and abs(got[0] - got[1]) < 0.1 and min(got[2:]) > 0.85
    assert [round(x, 12) for x in got] == [round(plain_likeness(*map(plain_anchors, p)), 12) for p in pairs]


def some_texts():
    rng = [xxhash.xxh64_intdigest(str(i).encode()) for i in range(400)]
    words = [f"w{x % 997}" for x in rng]
    passage, other = " ".join(words[:120]), " ".join(words[120:200])
    return [passage, f"{other} {passage}", f"{passage} {other}", f"{' '.join(words[:60])} new words {' '.join(words[60:120])}", "a b a b a b a b a b a b a b", "a b a b a b a b a b", "one two three four", "one two three four five", "", "x" * 100, "漢字" * 90, *(" ".join(words[i : i + i % 9]) for i in range(200, 230))]


def test_anchors_and_likenesses_by_hand(spark):
    texts = some_texts()
    got = [r.a for r in spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1).select(Y.anchors(F.col("t")).alias("a")).collect()]
    want = [plain_anchors(t) for t in texts]
    assert [[(x & (1 << Y.PLACE) - 1, x >> Y.PLACE & Y._MASK) for x in a] for a in got] == want
    pairs = [(i, j) for i in range(len(texts)) for j in range(len(texts)) if i < 11 or i == j or (i + j) % 5 == 0]
    df = spark.createDataFrame([(i, j, texts[i], texts[j]) for i, j in pairs], "i int, j int, a string, b string")
    for r in df.select("i", "j", Y.likeness(Y.anchors(F.col("a")), Y.anchors(F.col("b"))).alias("x"), Y.as_text(Y.anchors(F.col("a"))).alias("f")).collect():
        assert r.f == plain_text(want[r.i])
        assert abs(r.x - plain_likeness(want[r.i], want[r.j])) < 1e-12 and (r.x == 1.0 or texts[r.i] != texts[r.j])


def test_passages_are_found_at_their_offsets():
    own, moved, split = (plain_anchors(t) for t in (some_texts()[0], some_texts()[1], some_texts()[3]))
    assert {h for _, h in own} <= {h for _, h in moved} and len(own) > 20
    assert plain_likeness(own, moved) > 0.9 * len(own) / len(moved) and plain_likeness(own, split) > 0.8
    at = [p for p, _ in own]
    assert at == sorted(at) and max(b - a for a, b in zip(at, at[1:], strict=False)) <= Y.K - Y.S + 1


def led(rows):
    """Rows (id, text) in order, each with the text of the next."""
    signed = lambda t: (lambda h: h - (1 << 64) * (h >> 63))(xxhash.xxh64_intdigest(t.encode(), 42))
    order = sorted(((i, t or "") for i, t in rows), key=lambda x: (x[0] is not None, x[0] if x[0] is not None else "", signed(x[1])))
    return [(i, t, order[(k + 1) % len(order)][1]) for k, (i, t) in enumerate(order)]


def edited(text, following):
    cut = len(text) // 4
    return text[: len(text) - cut] + following[:cut]


def row_of(i, text, following):
    own, new, other = plain_anchors(text), plain_anchors(edited(text, following)), plain_anchors(following)
    return i, len(text), hashlib.sha256(edited(text, following).encode()).hexdigest(), plain_text(own), plain_text(new), round(plain_likeness(own, new), 9), round(plain_likeness(own, other), 9)


def rows_of(df):
    return sorted([(*tuple(r)[:5], round(r.near_edited, 9), round(r.near_next, 9)) for r in df.collect()], key=str)


def test_syncmer_fingerprints(docs, rows, none):
    assert rows_of(Y.syncmer_fingerprints(docs)) == sorted([row_of(*x) for x in led([r[:2] for r in rows])], key=str)
    assert Y.syncmer_fingerprints(none).collect() == []


@pytest.mark.parametrize("kind", ["bigint", "string", "date"])
def test_neighbours_of_any_ids(spark, kind):
    ids = [None, None, 3, 5, 5, 8, 900_000_000_000_000, -7] + list(range(40, 80))
    cast = {"bigint": lambda i: i, "string": lambda i: f"k{i}", "date": lambda i: datetime.date(2000, 1, 1) + datetime.timedelta(days=i % 4000)}[kind]
    rows = [(None if i is None else cast(i), f"text {k} of {i}") for k, i in enumerate(ids)]
    df = spark.createDataFrame(rows, f"id {kind}, text string").repartition(4)
    for per_bucket in (1, 5, 1000):
        got = sorted([(r.id, r.text, r.next_text) for r in Y.with_next(df, per_bucket).collect()], key=str)
        assert got == sorted(led(rows), key=str)


def test_syncmers_on_documents(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert rows_of(QUERIES["op6_syncmers"](spark, sf)) == sorted([row_of(*x) for x in led(docs)], key=str)
    near = [r for r in (row_of(*x) for x in led(docs)) if r[1] > 2000]
    assert sum(r[5] for r in near) / len(near) > 0.4 > sum(r[6] for r in near) / len(near)


def test_url_filter(spark):
    entries = spark.createDataFrame(
        [("A.com", "2021-01-01", "block"), ("a.com", "2021-03-01", "allow"), ("x.a.com", "2021-02-01", "block"), (None, "2021-01-01", "block"), ("b.com", None, "block"), ("a.com", "2021-01-01", "allow")], "domain string, d string, action string"
    ).select("domain", F.to_timestamp("d").alias("listed_at"), "action")
    urls = [
        ("http://a.com/", "2020-12-31"), ("http://a.com/", "2021-01-01"), ("http://u:p@X.A.com:80/p?q", "2021-02-15"), ("https://y.x.a.com./", "2021-04-01"), ("http://aa.com", "2021-02-02"), ("nonsense", "2021-02-02"), (None, "2021-02-02"), ("http://a.com", None), ("http://b.com", "2022-01-01"),
    ]
    caps = spark.createDataFrame([(i, *u) for i, u in enumerate(urls)], "id int, url string, d string").select("id", "url", F.to_timestamp("d").alias("fetched_at"), F.lit("x").alias("blocked"), F.lit("y").alias("_row"))
    got = {r.id: (r.host, r.n_active, r.rule_domain, r.blocked) for r in U.filter_urls(caps, entries).collect()}
    assert got == {
        0: ("a.com", 0, None, False), 1: ("a.com", 1, "a.com", True), 2: ("x.a.com", 2, "x.a.com", True), 3: ("y.x.a.com", 2, "x.a.com", True), 4: ("aa.com", 0, None, False), 5: (None, 0, None, False), 6: (None, 0, None, False), 7: ("a.com", 0, None, False), 8: ("b.com", 0, None, False),
    }
    assert U.filter_urls(caps.limit(0), entries).collect() == [] and U.filter_urls(caps, entries.limit(0)).where("blocked").count() == 0


def active(entries, host, at):
    """Active entries of the host and its parents, the most specific first, by hand."""
    found = []
    parts = host.split(".")
    for k in range(len(parts)):
        own = sorted((t, a) for d, t, a in entries if d == ".".join(parts[k:]) and t <= at)
        if own:
            found.append((".".join(parts[k:]), own[-1][1]))
    return found


def test_long_lists_and_captures_at_an_entrys_instant(spark, monkeypatch):
    import random

    rng = random.Random(9)
    name = lambda: ".".join(rng.choice(("a", "b", "c", "dd", "e")) for _ in range(rng.randrange(1, 3))) + rng.choice((".com", ".net", ".org.uk"))
    entries = list({(name(), rng.randrange(20)): rng.choice(("block", "allow")) for _ in range(300)}.items())
    entries = [(d, t, a) for (d, t), a in entries]
    asked = [(i, f"http://{rng.choice(('x.', 'a.', ''))}{name()}/p", rng.randrange(22)) for i in range(500)]
    asked += [(500 + i, f"http://{d}/", t) for i, (d, t, _) in enumerate(entries)]
    at = F.expr("timestamp_seconds(1600000000 + t * 86400)")
    held = spark.createDataFrame(entries, "domain string, t int, action string").select("domain", at.alias("listed_at"), "action")
    caps = spark.createDataFrame(asked + asked[:50], "id int, url string, t int").select("id", "url", "t", at.alias("fetched_at"))
    want = {}
    for i, url, t in asked:
        found = active(entries, url[7:].split("/")[0], t)
        want[i] = (len(found), *(found[0] if found else (None, None)))
    for most, hot in ((200_000, 1_000), (0, 1_000), (0, 5)):
        monkeypatch.setattr(U, "BROADCAST_ENTRIES", most)
        monkeypatch.setattr(U, "HOT", hot)
        rows = U.filter_urls(caps, held).collect()
        assert len(rows) == len(asked) + 50 and {r.id: (r.n_active, r.rule_domain, r.rule_action) for r in rows} == want


def test_names_without_an_entry_are_not_joined(spark, monkeypatch):
    monkeypatch.setattr(U, "BROADCAST_ENTRIES", 0)
    hosts = spark.range(1000).select(F.concat(F.lit("h"), F.col("id").cast("string"), F.lit(".com")).alias("host"))
    both = hosts.select("host", F.explode(F.array("host", F.lit("com"))).alias("domain"))
    held = spark.createDataFrame([("h7.com", 1)], "domain string, x int")
    left, _ = U.listed_names(both, held)
    assert left.where("domain = 'com'").count() == 0 and left.count() == 1000


def test_cells_do_not_depend_on_how_many_values_there_are(spark, monkeypatch):
    rows = [(f"host{i:03d}", "en", i % 5) for i in range(300) for _ in range(1 + i % 3)] + [(None, None, 1)]
    df = spark.createDataFrame(rows, "source string, lang string, step int").repartition(7)
    some = sorted(map(str, S.curve_places(df, 4).collect()))
    cells = quantile_cells([r[0] for r in rows], 4)
    sums = df.groupBy("source").agg(F.count("*").alias("n"))
    assert {r.source: r.cell for r in S._quantile_cells(sums, "source", 4).collect()} == cells and len(set(cells.values())) == 16
    monkeypatch.setattr(S, "VALUES", 2)
    assert sorted(map(str, S.curve_places(df, 4).collect())) == some
