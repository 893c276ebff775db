"""Cases that once went wrong, clashing names, queries against their SQL, and what must hold at scale."""

import collections
import importlib
import re
import time

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from claimweave.llm import ann, bpe, common, decontaminate, line_dedup, lm, near_dedup, queries, toxicity, url_filter

SF = "/root/testdata/sf0.001"
DOC = "doc_id bigint, text string"


def frame(spark, rows, schema=DOC):
    return spark.createDataFrame(rows, schema)


def say(n, letter="w"):
    return " ".join(f"{letter}{i}" for i in range(n))


# Every query that SQL can state.


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_rows(spark, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark", "pages", "conversations", "embeddings", "labels"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    cursor = con.execute(queries.ORACLE_SQL[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    order = sorted(columns)
    want = sorted((tuple(r[columns.index(c)] for c in order) for r in cursor.fetchall()), key=repr)
    assert sorted((tuple(r[c] for c in order) for r in df.collect()), key=repr) == want


# Shared folder


def test_no_local_folder_on_a_cluster(spark):
    class Context:
        master = "spark://host:7077"
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        sparkContext = Context
        conf = {}

    with pytest.raises(ValueError):
        common.shared_folder(Session)


# 6


def test_rows_that_share_an_id_keep_their_links(spark):
    a, b = say(40), say(40, "v")
    near = lambda text: text.rsplit(" ", 1)[0] + " z"
    rows = [(1, a), (1, b), (2, near(a)), (3, near(b)), (None, near(near(a)) + " y"), (5, "")]
    for k in (2, 5):
        got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(frame(spark, rows), k=k).collect()}
        assert got == {1: 1, 2: 1, 3: 1, None: 1, 5: 5}, k
    kept = near_dedup.keep_one(frame(spark, [*rows, (6, "a text of its own"), (2, "another text of its own"), (1, a)]).withColumn("_id", F.lit("mine")), k=2)
    assert kept.columns == ["doc_id", "text", "_id"]
    assert sorted((r["doc_id"], r["text"]) for r in kept.collect()) == sorted([(1, a), (1, b), (5, ""), (6, "a text of its own"), (2, "another text of its own")])


def test_large_neighbourhoods_in_blocks(spark, monkeypatch):
    """Many members that meet in buckets, alike only in part: blocks of four rows find the links of all pairs."""
    monkeypatch.setattr(near_dedup, "BLOCK_ROWS", 4)
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(60)]
    docs = []
    for i in range(40):
        words = list(base)
        for at in rng.choice(60, int(rng.integers(0, 8)), replace=False):
            words[at] = f"x{rng.integers(0, 5)}"
        docs.append((i, " ".join(words)))
    sets = {i: {tuple(w[j : j + 2]) for j in range(len(w) - 1)} for i, t in docs for w in [t.split()]}
    root = {i: i for i in sets}
    for _ in sets:
        for x in sets:
            for y in sets:
                if 100 * len(sets[x] & sets[y]) >= 80 * len(sets[x] | sets[y]):
                    root[x] = root[y] = min(root[x], root[y])
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(frame(spark, docs), k=2).collect()}
    assert got == root and len(set(root.values())) > 1


# 2


def test_rows_that_share_an_id_are_judged_apart(spark):
    item = say(14)
    docs = [(1, say(12)), (1, "x x " + " ".join(item.split()[2:])), (1, "x x"), (None, item), (None, item), (None, None)]
    items = frame(spark, [(7, item)], "item_id bigint, text string")
    for most in (1 << 20, 0):
        got = sorted((r["doc_id"] or 0, r["n_words"], r["n_hit"], r["item_ids"]) for r in decontaminate.contamination(frame(spark, docs), items, max_broadcast=most).collect())
        assert got == [(0, 0, 0, []), (0, 14, 14, ["7"]), (0, 14, 14, ["7"]), (1, 2, 0, []), (1, 12, 12, ["7"]), (1, 14, 12, ["7"])]
    kept = decontaminate.drop_contaminated(frame(spark, docs).withColumns({"_id": F.lit(1), "key": F.lit(2)}), items)
    assert kept.columns == ["doc_id", "text", "_id", "key"] and sorted((r["doc_id"] or 0, r["text"]) for r in kept.collect()) == [(0, None), (1, "x x")]


def test_a_passage_of_many_items_is_one_row(spark):
    """Fingerprints are thinned, and what many items share is joined once."""
    items = frame(spark, [(i, say(30)) for i in range(50)], "item_id bigint, text string")
    words = items.select("item_id", common.words(F.col("text"), common.WORD_SEPARATORS).alias("w"))
    windows = decontaminate.item_windows(words, 10, 5, [])
    assert windows.count() <= 13 and {len(r["items"]) for r in windows.collect()} == {50}
    got = decontaminate.contamination(frame(spark, [(i, f"a{i} {say(30)} b{i}") for i in range(60)]), items).collect()
    assert {(r["n_words"], r["n_hit"], len(r["item_ids"])) for r in got} == {(32, 30, 50)} and len(got) == 60


# 1


def test_scores_by_brute_force(spark):
    lexicon = toxicity.Lexicon({"zwurg": 2.0, "vexx": 1.5, "xx ": 0.5, "vexxolong": 3.0}, ["vexxo", "mild zwurgel", "zwurgel cake now"], (-4.0, 1.0, 0.5))
    texts = ["", None, "zwurgel", "a mild zwurgel here", "mild zwurgels", "vexxo vexxos vexxolongest", "xx xxx x", "zwurgel cake now zwurgel cake", "ZWURG3L​! mild  zwurgel", "plain words only", "zwurgel " * 3000]
    phrases = {tuple(toxicity.folded(e).split()): 0.0 for e in lexicon.exceptions}

    def weight(text):
        words, at, total = toxicity.folded(text).split(), 0, 0.0
        while at < len(words):
            spans = [n for n in (3, 2, 1) if tuple(words[at : at + n]) in phrases]
            fits = [(len(toxicity.folded(e).strip()), w) for e, w in lexicon.weights.items() if (words[at] == toxicity.folded(e).strip() if e.endswith(" ") else words[at].startswith(toxicity.folded(e).strip()))]
            if spans:
                at += spans[0]
                continue
            total += max(fits)[1] if fits else 0.0
            at += 1
        return total, len(words)

    got = {r["doc_id"]: r for r in toxicity.score(frame(spark, list(enumerate(texts))), lexicon).collect()}
    for i, text in enumerate(texts):
        w, n = weight(text)
        z = lexicon.curve[0] + lexicon.curve[1] * np.log1p(w) + lexicon.curve[2] * np.log1p(1000 * w / (n + 20.0))
        assert got[i]["score"] == pytest.approx(1 / (1 + np.exp(-z))) and got[i]["predicted"] == int(got[i]["score"] >= 0.3), text


def test_phrases_are_learned(spark):
    """A word that is toxic by itself, and harmless after another."""
    rng = np.random.default_rng(1)
    plain = [f"{c}{i}or" for c in "bcdfm" for i in ("a", "e", "u")]
    fill = lambda: " ".join(rng.choice(plain, 12))
    rows = [(i, f"{fill()} zwurgel {fill()}", 1) for i in range(0, 120)] + [(i, fill(), 0) for i in range(120, 2200)] + [(i, f"{fill()} garden zwurgel {fill()}", 0) for i in range(2200, 2212)]
    docs = frame(spark, [r[:2] for r in rows])
    lexicon = toxicity.learn(docs, spark.createDataFrame([(i, t) for i, _, t in rows], "doc_id bigint, toxic int"))
    assert "garden zwurgei" in lexicon.exceptions or "garden zwurgel" in lexicon.exceptions
    got = {r["doc_id"]: r["predicted"] for r in toxicity.score(frame(spark, [(1, "one zwurgel here"), (2, "one garden zwurgel here")]), lexicon).collect()}
    assert got == {1: 1, 2: 0}


def test_sample_is_bounded(spark):
    docs = frame(spark, [(1, f"text {i}") for i in range(50)] + [(2, "other")])
    sample = toxicity.labelled_sample(docs, spark.createDataFrame([(1, 1), (2, 0), (3, 0)], "doc_id bigint, toxic int"), "doc_id", "text", most=2)
    assert sample.count() <= 2


def test_names_of_results_keep_their_values(spark):
    docs = frame(spark, [(1, "a\nb"), (2, "a\nc"), (3, "a"), (4, None)])
    mine = docs.withColumns({c: F.lit(0.77) for c in ("score", "predicted", "n_lines", "n_dropped", "_drop", "_id", "_site", "_lines", "_kept", "site", "key", "id", "n_tokens")})
    lexicon = toxicity.Lexicon({"zzz": 1.0}, [], (-4.0, 1.0, 1.0))
    lines = line_dedup.drop_boilerplate(mine, F.lit("s"), ratio=0.5)
    assert {r["text"] for r in lines.collect()} == {"b", "c", "", None} and {r["n_dropped_"] for r in lines.collect()} == {1, 0}
    for out in (toxicity.drop_toxic(mine, lexicon), lines.select(*mine.columns), near_dedup.keep_one(mine), decontaminate.drop_contaminated(mine, frame(spark, [(1, "x")], "item_id bigint, text string"))):
        assert out.columns == mine.columns and {r[c] for r in out.collect() for c in mine.columns[2:]} == {0.77}
    for made in (bpe.round_trip(mine, ["doc_id", "n_tokens"]), bpe.tokenize(mine, ["doc_id", "n_tokens"])):
        assert len(set(made.columns)) == len(made.columns) and made.count() == 4
    pages = mine.select(F.col("doc_id").alias("page_id"), F.lit("http://a.com/en/").alias("url"), F.lit(1).alias("slice"), F.lit(2).alias("rule"))
    assert {r["rule"] for r in url_filter.filter_urls(pages, url_filter.rule_rows(spark, url_filter.RULES)).collect()} == {"com/en/"}


# 7


def test_lines_of_a_page_cost_in_proportion(spark):
    """Pages that share ever more lines, all boilerplate: twice the lines, about twice the time (17 s for four pages of 20,000 before)."""

    def seconds(n):
        text = "\n".join(f"line {i}" for i in range(n))
        pages = frame(spark, [(i, text) for i in range(4)])
        began = time.perf_counter()
        assert line_dedup.drop_boilerplate(pages, F.lit("s"), ratio=0.5).agg(F.sum("n_dropped")).first()[0] == 4 * n
        return time.perf_counter() - began

    seconds(1000)
    assert seconds(80_000) < 16 * seconds(10_000)


# 4


def test_a_match_of_megabytes_is_linear():
    import public_tokenizers as public

    own = bpe.ByteBPE(bpe.parse_ranks(bpe.read_ranks(public.path("byte_bpe_50k.tiktoken"))), public.PATTERN)
    rng = np.random.default_rng(2)
    text = "".join(rng.choice(list("abcdefghinorst"), 5_000_000))
    began = time.time()
    ids = own.encode(text)
    assert time.time() - began < 60 and own.decode(ids) == text.encode()


# 3


def test_a_host_of_many_rules_and_pages(spark):
    rules = [("big.com", f"/{i % 100}/{i}", "block" if i % 2 else "allow") for i in range(10_000)] + [("big.com", f"/{i}", "block") for i in range(100)] + [("com", "/7", "allow")]
    pages = [(i, f"http://w{i % 3}.big.com/{i % 100}/{i % 12_000}x") for i in range(15_000)] + [(-1, "http://big.com/7/7")] * 500
    df = frame(spark, pages, "page_id bigint, url string").repartition(8)
    got = collections.Counter(tuple(r) for r in url_filter.filter_urls(df, spark.createDataFrame(rules, "host string, path string, action string"), rows_per_slice=2000).collect())
    by = {h + p: (len(h + p), len(h), a, h + p) for h, p, a in rules}
    want = collections.Counter()
    for i, url in pages:
        host, path = re.match(r"http://([^/]*)(.*)", url).groups()
        fits = [by[h + path[:n]] for h in ("big.com", "com") for n in range(len(path) + 1) if h + path[:n] in by]
        best = max(fits, default=None)
        want[i, host, path, best and best[3], best[2] if best else "allow"] += 1
    assert got == want


def test_rules_are_those_of_the_contract(spark):
    urls = ["http://a.com/en/1", "http://example.com/en/7x", "http://a.net/de/1", "http://www.example.net/de/8", "http://example.net/de/9", "http://x.org/es/", "http://x.org/"]
    want = ["com/en/ block", "example.com/en/7 allow", "net/de/ allow", "example.net/de/8 block", "net/de/ allow", "org/es/ block", "None allow"]
    pages = frame(spark, list(enumerate(urls)), "page_id bigint, url string")
    got = url_filter.filter_urls(pages, url_filter.rule_rows(spark, url_filter.RULES)).orderBy("page_id").collect()
    assert [f"{r['rule']} {r['verdict']}" for r in got] == want
    con = duckdb.connect()
    con.execute("CREATE TABLE pages AS SELECT * FROM (VALUES " + ", ".join(f"({i}, '{u}')" for i, u in enumerate(urls)) + ") t(page_id, url)")
    assert [f"{r[3]} {r[4]}" for r in sorted(con.execute(queries.ORACLE_SQL["op3_url_filter"]).fetchall())] == want


# 8


def test_vectors_of_each_length(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=4 if i % 3 else 7)]) for i in range(150)]
    df = frame(spark, rows, "vec_id bigint, embedding array<double>")
    want = set()
    for q, x in rows:
        if q % 20 == 0:
            best = sorted((-float(np.dot(x, y)), i) for i, y in rows if i != q and len(y) == len(x))[:20]
            want |= {(q, n + 1, i) for n, (_, i) in enumerate(best)}
    for size in (16, 1000):
        got = ann.nearest(df, F.col("vec_id") % 20 == 0, shard_rows=size, block_rows=3, leaf_rows=4).collect()
        assert {(r["query_id"], r["rank"], r["vec_id"]) for r in got} == want


def test_recall_on_a_table(spark):
    rows = common.table(spark, SF, "embeddings").select("vec_id", "embedding").collect()
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    got = collections.defaultdict(set)
    for r in queries.QUERIES["op8_nearest"](spark, SF).collect():
        got[r["query_id"]].add(r["vec_id"])
    hits = total = 0
    for q in np.flatnonzero(ids % 20 == 0):
        s = x @ x[q]
        s[q] = -np.inf
        best = ids[np.lexsort((ids, -s))[:20]]
        hits, total = hits + len(got[ids[q]] & set(best.tolist())), total + len(best)
    assert total and hits >= 0.999 * total


# 5


def test_a_long_text_is_scored_in_slices(spark, monkeypatch):
    """One text over many slices, beside short ones, equals what one slice gives."""
    rng = np.random.default_rng(4)
    texts = [" ".join(rng.choice(list("abcdefgh"), n)) for n in (900, 0, 3, 40, 1)]
    import pyarrow as pa

    h = pa.array([[hash(w) & (1 << 62) - 1 for w in t.split()] for t in texts], pa.list_(pa.int64()))
    rows = pa.table({"id": pa.array(range(5), pa.int64()), "held_out": pa.array([False, False, True, False, False]), "h": h, "block": pa.array([0] * 5, pa.int32())})
    results = []
    for size in (1 << 18, 7):
        monkeypatch.setattr(lm.slices, "__defaults__", (size,))
        replies = lm._answer(lm._ask(3)(rows).filter(pa.compute.equal(lm._ask(3)(rows).column("shard"), 0)))
        every = pa.concat_tables([replies, *(lm._answer(lm._ask(3)(rows).filter(pa.compute.equal(lm._ask(3)(rows).column("shard"), i))) for i in (1, 2))])
        results.append(lm._scorer(pa.int64())(rows, every).to_pylist())
    assert [{k: v for k, v in r.items() if k != "score"} for r in results[0]] == [{k: pytest.approx(v) for k, v in r.items() if k != "score"} for r in results[1]]
    assert [r["score"] for r in results[0]] == pytest.approx([r["score"] for r in results[1]])


def test_encoders_remember_as_much_as_they_are_told():
    import public_tokenizers

    data = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    small, large = (bpe.encoder_of(data, public_tokenizers.PATTERN, n) for n in (10, 100_000))
    texts = [say(40, f"word{k}x") for k in range(6)] + [say(40, "word0x")] * 2
    assert small is not large and [small.encode(t) for t in texts] == [large.encode(t) for t in texts]
    assert len(small.words) <= 60 < len(large.words)
