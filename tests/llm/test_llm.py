"""Each operator against a brute-force version, with nulls, empty texts, ties, copies, empty tables and clashing columns."""

import base64
import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from claimweave.llm import ann, bpe, chat, common, decontaminate, line_dedup, lm, near_dedup, token_counts, toxicity, url_filter
from claimweave.llm.components import components

DOC = "doc_id bigint, text string"


def frame(spark, rows, schema=DOC):
    return spark.createDataFrame(rows, schema)


# 3: URL filters


def test_urls(spark):
    urls = ["http://com/en/1", "https://A.Example.COM/en/70?q", "http://x.net/de/", "http://example.net/de/8#f", "ftp://org/es", "http://a.org/es/x", "no url", None, "http://notcom/en/", "http://sub.com:80/en/", "x://y://com/en/", "http://example.com", "http://com/en/\U0010ffff"] * 3
    pages = frame(spark, [(i % 17 if i % 5 else None, u, "clash") for i, u in enumerate(urls)], "page_id bigint, url string, rule string")
    rules = spark.createDataFrame(url_filter.RULES + [("example.com", "/en/7", "block"), ("com", "", "allow")], "host string, path string, action string")
    got = collections.Counter(tuple(r) for r in url_filter.filter_urls(pages, rules, rows_per_slice=2).collect())

    def judge(url):
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
        host, path = (m[1].lower(), m[2]) if m else ("", "")
        every = [*url_filter.RULES, ("example.com", "/en/7", "block"), ("com", "", "allow")]
        fits = [(len(h + p), len(h), a, h + p) for h, p, a in every if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=None)
        return host, path, best and best[3], best[2] if best else "allow"

    assert got == collections.Counter((r["page_id"], *judge(r["url"])) for r in pages.collect())
    assert url_filter.filter_urls(pages.limit(0), rules).count() == 0
    assert {r["verdict"] for r in url_filter.filter_urls(pages, rules.limit(0)).collect()} == {"allow"}


# 4: byte-level BPE


@pytest.fixture(scope="module")
def encoders():
    import public_tokenizers as public
    import tiktoken

    ranks = bpe.parse_ranks(bpe.read_ranks(public.path("byte_bpe_50k.tiktoken")))
    return bpe.ByteBPE(ranks, public.PATTERN), tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_is_exact(encoders):
    own, other = encoders
    rng = random.Random(5)
    texts = ["", " ", "a" * 5000, "  two  spaces \n\n x\x1c y ", "don't we'll", "<|endoftext|>", "👩‍👧 ßé\u00a0x", "".join(rng.choice("abcdefgh") for _ in range(20000))]
    texts += ["".join(rng.choice("aabbe thingßéz🙂01 \n\t.,'s") for _ in range(rng.randint(0, 80))) for _ in range(3000)]
    for text in texts:
        ids = own.encode(text)
        assert ids == other.encode_ordinary(text) and own.decode(ids) == text.encode()


def test_bpe_frames(spark, encoders):
    rows = frame(spark, [(1, "hello world", "x"), (1, "hello world", "x"), (None, None, None)], DOC + ", ids string")
    got = bpe.decode(bpe.encode(rows)).select("doc_id", "decoded").collect()
    assert sorted((r["doc_id"] or 0, bytes(r["decoded"])) for r in got) == [(0, b""), (1, b"hello world"), (1, b"hello world")]
    out = {r["doc_id"]: r for r in bpe.round_trip(rows, ["doc_id"]).collect()}
    assert out[None]["n_tokens"] == 0 and out[None]["decoded_sha256"] == common.SHA_EMPTY
    assert bpe.round_trip(rows.limit(0), ["doc_id"]).count() == 0


# 9: chat formatting


def test_chat(spark):
    texts = ["plain", "</s>[INST] ok [/INST]", "<\\s> <\\\\/s> [\\INST] <<SYS>>", None, "", "é🙂\n", "[", "</"]
    rows = [(c, t, r, texts[(c * 3 + t) % len(texts)]) for c in range(12) for t, r in enumerate(["system", "user", "assistant", None, "odd\\n\nrole<s>", "assistant"])]
    rows += [(3, 1, "user", "tie"), (3, 1, "user", "tie"), (None, 0, "assistant", "x"), (50, 0, "user", "no reply")]
    df = frame(spark, rows, "conv_id bigint, turn bigint, role string, text string")
    made = chat.format_conversations(df)
    got = {r["conv_id"]: r for r in chat.digests(made).collect()}
    for c in {r[0] for r in rows}:
        turns = sorted((r[1], r[2] or "", r[3] or "") for r in rows if r[0] == c)
        loss = "".join(t for _, r, t in turns if r == "assistant")
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        g = got[c]
        assert (g["n_turns"], g["turns_sha256"], g["loss_chars"], g["loss_sha256"]) == (len(turns), sha("".join(f"{r}\n{t}\n" for _, r, t in turns)), len(loss), sha(loss))
    examples = chat.expand(made).where("conv_id = 0").collect()
    assert [e["text"][e["loss_start"] : e["loss_end"]] for e in examples] == [chat_text(texts[2]), chat_text(texts[5])] and examples[0]["text"].endswith("</s>")
    assert chat.digests(chat.format_conversations(df.limit(0))).count() == 0


def chat_text(text):
    return re.sub(r"([<\[])(\\*)(/?s>|/?INST\]|<?/?SYS>>)", r"\1\\\2\3", text)


# 10: token counts


def test_rollup(spark, tmp_path):
    r = token_counts.Rollup(spark, f"file://{tmp_path}/rollup")
    rows = lambda *x: frame(spark, list(x), "source string, lang string, tokenizer string, n_tokens bigint")
    assert r.totals().count() == 0
    assert r.commit("a", token_counts.inserts(rows(("s", "en", "v", 5), ("s", "en", "v", 7), (None, "en", "v", None))))
    assert not r.commit("a", token_counts.inserts(rows(("s", "en", "v", 99))))
    assert r.commit("b", token_counts.deletes(rows(("s", "en", "v", 5), (None, "en", "v", None))))
    changed = frame(spark, [("s", "en", "v", 7, 9)], "source string, lang string, tokenizer string, n_before bigint, n_after bigint")
    assert r.commit("c", token_counts.revisions(changed)) and r.commit("empty", token_counts.inserts(rows()))
    # A batch whose first attempt died before its commit mark.
    (tmp_path / "rollup" / "batch=d").mkdir()
    assert r.commit("d", token_counts.inserts(rows(("t", "de", "v", 1))))
    want = {("s", "en", "v", 1, 9), ("t", "de", "v", 1, 1)}
    assert {tuple(x) for x in r.totals().collect()} == want
    r.compact()
    assert {tuple(x) for x in r.totals().collect()} == want and not r.commit("b", token_counts.inserts(rows(("s", "en", "v", 1))))
    with pytest.raises(ValueError):
        r.commit("a/b", rows())


# 1: toxicity


def test_toxicity(spark):
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdeghmnoprsu") for _ in range(rng.randint(2, 8))) for _ in range(300)]
    rows, labels = [], []
    for i in range(600):
        text = [rng.choice(words) for _ in range(rng.randint(5, 80))]
        bad = i % 5 == 0
        if bad:
            text[rng.randrange(len(text))] = rng.choice(["zwurgel", "zwurgelz", "Zwurg3l", "vexxo"])
        rows.append((i, " ".join(text), 0.5))
        labels.append((i, int(bad)))
    rows += [(1000, None, 0.1), (1001, "", 0.1), (1002, "zwυrgеl!", 0.1), (1003, "z\u200bwurgel", None)]
    docs = frame(spark, rows, DOC + ", score double")
    known = frame(spark, [*labels, (5, None), (0, 0)], "doc_id bigint, toxic int")
    lexicon = toxicity.learn(docs, known)
    got = {r["doc_id"]: r for r in toxicity.score(docs, lexicon).collect()}
    assert sum(got[i]["predicted"] == t for i, t in labels) >= 595 and all(0 <= r["score"] <= 1 for r in got.values())
    assert not got[1000]["predicted"] and not got[1001]["predicted"] and got[1002]["predicted"] and got[1003]["predicted"]
    assert toxicity.drop_toxic(docs, lexicon).columns == docs.columns
    assert {r["score"] for r in toxicity.score(docs.limit(5), toxicity.learn(docs, known.limit(0))).collect()} == {0.0}
    held = toxicity.training_labels(known)
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2 for r in held.collect())


def test_exceptions_cover_entries():
    lexicon = toxicity.Lexicon({"clown": 3.0}, ["clown fish"])
    weigh = lexicon.matcher()
    assert weigh("Clown fish, clown-fish") == (0.0, 4) and weigh("the cl0wn fishes clowns") == (6.0, 4) and weigh(None)[0] == 0


def test_signs_for_i_and_l():
    """1, | and ! are read as i and as l, in narrow and wide letters."""
    weigh = toxicity.Lexicon({"clown": 1.0, "loser": 2.0, "worthless": 4.0, "idiot": 8.0}).matcher()
    for text, weight in (("1oser", 2), ("c1own c|own c!own", 3), ("wor7h1ess", 4), ("1d1ot id!ot", 16), ("ｌｏｓｅｒ １oser loser", 6), ("crown poser", 0)):
        assert weigh(text)[0] == weight, text


# 7: line dedup


def test_lines(spark):
    rows = [(i, "a" if i < 8 else None, f"nav \nown {i}\n\n nav\nrare" if i % 2 else f"own {i}\nrare") for i in range(12)] + [(99, "b", None), (98, "b", ""), (98, "b", "")]
    df = frame(spark, rows, "doc_id bigint, site string, text string").withColumn("n_lines", F.lit("clash"))
    want = {}
    for i, s, t in rows:
        if t is None:
            want[i] = None
            continue
        group = [x for x in rows if x[1] == s]
        share = lambda line: sum(line.strip() in [y.strip() for y in (x[2] or "").split("\n")] for x in group)
        want[i] = "\n".join(x for x in t.split("\n") if not x.strip() or not (share(x) >= 3 and share(x) > 0.5 * len(group)))
    for most in (200_000, 0):
        got = line_dedup.drop_boilerplate(df, F.col("site"), ratio=0.5, max_broadcast=most, salts=3).collect()
        assert len(got) == len(rows) and {r["doc_id"]: r["text"] for r in got} == want
    assert line_dedup.drop_boilerplate(df.limit(0), F.col("site")).count() == 0


def test_lines_of_large_source(spark):
    """A long passage on 1 % of a source's pages goes; a line on two pages, copied pages and the small source stay."""
    long = " ".join(f"w{i}" for i in range(60))
    few = "this line stands on two pages of the source"
    texts = [f"own {i}\n{long}\nend {i}" if i % 100 == 0 else f"own {i}\n{few}" if i % 300 == 1 else f"own {i}\nend {i}" for i in range(600)]
    texts[50:58] = ["copied as a whole\nwith each line"] * 8
    rows = [(i, "large", t) for i, t in enumerate(texts)] + [(1000 + i, "small", f"own {i}\n{few}") for i in range(2)]
    df = frame(spark, rows, "doc_id bigint, source string, text string").withColumn("n_chars", F.char_length("text").cast("long"))
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in corpus_pipeline.drop_boilerplate_lines(spark, df, "").collect()}
    want = {i: t.replace(f"\n{long}", "") for i, _, t in rows}
    assert got == {i: (t, len(t)) for i, t in want.items()}


# 2: decontamination


def _words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def test_decontamination(spark):
    rng = random.Random(9)
    vocabulary = ["ab", "É1", "cd", "x", "naïve", "7"]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, say(rng.choice([0, 1, 3, 7, 9, 10, 11, 25]) if i % 4 == 0 else rng.randint(10, 40))) for i in range(12)] + [(3, "some other words of the same id to find in documents here"), (None, "a null id has hits but is not listed at all"), (77, None)]
    docs = [(i, say(rng.randint(0, 30)) + (", " + (rng.choice(items)[1] or "") if i % 3 == 0 else "")) for i in range(60)] + [(100, None), (101, ""), (102, "x A null ID has hits but is not listed, AT all")]
    got = {r["doc_id"]: r for r in decontaminate.contamination(frame(spark, docs).withColumn("pos", F.lit(1)), frame(spark, items, "item_id bigint, text string")).collect()}
    far = {r["doc_id"]: r for r in decontaminate.contamination(frame(spark, docs), frame(spark, items, "item_id bigint, text string"), max_broadcast=0).collect()}
    assert got == far
    for i, text in docs:
        w, hit, found = _words(text), set(), set()
        for item, said in items:
            v = _words(said)
            n = min(len(v), 10)
            for p in range(len(v) - n + 1) if n else ():
                for at in range(len(w) - n + 1):
                    if w[at : at + n] == v[p : p + n]:
                        hit.update(range(at, at + n))
                        found |= {str(item)} if item is not None else set()
        g = got[i]
        assert (g["n_words"], g["n_hit"], g["item_ids"], g["contaminated"]) == (len(w), len(hit), sorted(found), bool(hit)), i
    empty = frame(spark, [], "item_id bigint, text string")
    assert decontaminate.drop_contaminated(frame(spark, docs), empty).count() == len(docs)


# 6: near duplicates


def test_near_duplicates(spark):
    rng = random.Random(4)
    base = [f"w{rng.randrange(400)}" for _ in range(120)]
    docs = [(i, " ".join(rng.choice(base) if rng.random() < rate else w for w in base)) for i, rate in enumerate([0.0, 0.02, 0.05, 0.08, 0.1, 0.12, 0.15] * 12)]
    docs += [(1000 + i, " ".join(f"v{rng.randrange(500)}" for _ in range(60))) for i in range(20)] + [(1, docs[5][1]), (2000, docs[9][1]), (2001, docs[9][1].upper()), (2002, None), (2003, " \n"), (2004, "one"), (2005, "ONE"), (None, docs[9][1])]
    for k in (2, 5):
        sets = {}
        for i, t in docs:
            w = (t or "").encode().lower().split()
            sets.setdefault(i, []).append({tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
        ids = [i for i in sets if i is not None]
        root = {i: i for i in ids}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a in ids:
            for b in ids:
                if a < b and any(s and t and 100 * len(s & t) >= 80 * len(s | t) for s in sets[a] for t in sets[b]):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
        got = near_dedup.near_duplicates(frame(spark, docs).withColumn("bands", F.lit(1)), k=k).collect()
        assert len(got) == len(docs)
        for r in got:
            if r["doc_id"] is not None and r["n_shingles"]:
                assert (r["component_id"], r["kept"]) == (find(r["doc_id"]), find(r["doc_id"]) == r["doc_id"]), (k, r)
            elif r["doc_id"] is not None:
                assert r["component_id"] == r["doc_id"] and r["kept"]
    kept = near_dedup.keep_one(frame(spark, docs), k=2)
    assert kept.where("doc_id is not null").count() == kept.where("doc_id is not null").select("doc_id").distinct().count()
    assert near_dedup.near_duplicates(frame(spark, [])).count() == 0


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(30)] + [(rng.randrange(100, 200), rng.randrange(100, 200)) for _ in range(60)]
    root = list(range(200))
    for _ in range(200):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a bigint, b bigint"), "a", "b").collect()}
    assert got == {x: root[x] for e in edges if e[0] != e[1] for x in e}


# 5: language model


def test_language_model(spark):
    rng = random.Random(6)
    docs = [(i, " ".join(rng.choice("The the cat É sat mat on".split()) for _ in range(rng.randint(0, 40)))) for i in range(40)] + [(50, None), (51, ""), (52, "unseen\x0bwords"), (None, "the cat"), (3, "the cat"), (3, "the cat")]
    seq = [(i, ["<s>", *(t or "").encode().lower().split(), "</s>"]) for i, t in docs]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    c1 = collections.Counter(w for i, s in seq if not held(i) for w in s[1:])
    c2 = collections.Counter(p for i, s in seq if not held(i) for p in zip(s, s[1:]))
    total, kinds = sum(c1.values()), len(c1)
    want = collections.Counter()
    for i, s in seq:
        uni = lambda w: (c1[w] + 0.5) / (total + 0.5 * (kinds + 1))
        score = 0.0
        for h, w in zip(s, s[1:]):
            ch = c1["</s>"] if h == "<s>" else c1[h]
            fall = max(lm.FLOOR, 1 / (1 + (ch / lm.HALF) ** lm.POWER)) if ch else 1.0
            score += math.log10((1 - fall) * c2[h, w] / ch + fall * uni(w) if c2[h, w] else fall * uni(w))
        want[i, held(i), len(s) - 1, sum(c1[w] > 0 for w in s[1:]), total, round(sum(math.log10(uni(w)) for w in s[1:]), 6), round(score, 6)] += 1
    df = frame(spark, docs).withColumn("block", F.lit("clash"))
    for size in (1 << 20, 100):
        assert collections.Counter((*r[:5], round(r[5], 6), round(r[6], 6)) for r in lm.lm_scores(df, block_bytes=size).collect()) == want
    assert lm.lm_scores(df.limit(0)).count() == 0


def test_packing():
    rng = np.random.default_rng(1)
    for keys in (np.sort(rng.integers(0, 1 << 64, 500, np.uint64, endpoint=False)), np.array([0, 1, 3], np.uint64), np.empty(0, np.uint64)):
        assert (lm._unpack(lm._pack(keys)) == keys).all()
    counts = np.array([0, 1, 254, 255, 256, 10**12])
    assert (lm._unpack_counts(lm._pack_counts(counts)) == counts).all()


# 8: nearest neighbours


def test_nearest(spark):
    rng = np.random.default_rng(8)
    rows = [(i, [float(x) for x in rng.normal(size=6) * (1 + i % 3)]) for i in range(300)]
    rows += [(400 + i, rows[20][1]) for i in range(30)] + [(20, rows[21][1]), (500, None), (501, [0.0] * 6), (502, [float("nan")] * 6), (503, [1.0, None] * 3), (504, [1.0]), (None, rows[1][1]), (505, [float("inf")] * 6), (506, [])]
    df = frame(spark, rows, "vec_id bigint, embedding array<double>").withColumn("rank", F.lit(1))
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v and len(v) == 6 and None not in v and np.isfinite(v).all() and any(v)]
    want = collections.Counter()
    for at, (q, x) in enumerate(good):
        if q % 20 == 0:
            best = sorted((-float((x * y).sum()), i) for other, (i, y) in enumerate(good) if other != at)[:20]
            want.update((q, n + 1, i, -s) for n, (s, i) in enumerate(best))
    asked = F.col("vec_id") % 20 == 0
    got = ann.nearest(df, asked, shard_rows=64, block_rows=5, leaf_rows=8)
    assert collections.Counter(tuple(r) for r in got.collect()) == want
    loose = {(r["query_id"], r["vec_id"]) for r in ann.nearest(df, asked, shard_rows=64, block_rows=5, leaf_rows=8, factor=1.3).collect()}
    exact = {(q, i) for q, _, i, _ in want}
    assert len(loose & exact) >= 0.9 * len(exact)
    small = ann.nearest(df, asked, pack_bytes=8 * 6 * 10)  # ten rows a pack
    assert collections.Counter(tuple(r) for r in small.collect()) == want
    assert ann.nearest(df.limit(0), asked).count() == 0 and ann.nearest(df, F.lit(False)).count() == 0


def test_queries_that_share_an_id(spark):
    """Each has a list of its own, in which the other row of that id is a candidate."""
    rows = [(20, [1.0, 0.0]), (20, [0.0, 1.0])] + [(i, [float(i), 0.0] if i < 15 else [0.0, float(i)]) for i in range(1, 30) if i != 20]
    got = ann.nearest(frame(spark, rows, "vec_id bigint, embedding array<double>"), F.col("vec_id") == 20, k=5)
    lists = sorted((r["rank"], r["vec_id"]) for r in got.collect())
    assert lists == sorted([(n + 1, i) for n, i in enumerate([14, 13, 12, 11, 10])] + [(n + 1, i) for n, i in enumerate([29, 28, 27, 26, 25])])


# 9: chat formatting, from expanded examples


def test_chat_digests_read_examples(spark, monkeypatch):
    """Each example's own text is what is digested, so a wrong one shows; conversations without examples stay."""
    rows = [(1, 0, "user", "a </s> b"), (1, 1, "assistant", "one <s>"), (1, 2, "user", "c"), (1, 3, "assistant", "two"), (None, 0, "assistant", "three"), (2, 0, "user", "alone")]
    df = chat.format_conversations(frame(spark, rows, "conv_id bigint, turn bigint, role string, text string"))
    texts = collections.Counter()
    for r in chat.expand(df).collect():
        texts[r["conv_id"]] += len(r["text"])
    got = {r["conv_id"]: r for r in chat.digests(df).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert {k: (r["loss_sha256"], r["formatted_chars"]) for k, r in got.items()} == {k: (sha(s), texts[k]) for k, s in ((1, "one <s>two"), (None, "three"), (2, ""))}
    expand = chat.expand
    monkeypatch.setattr(chat, "expand", lambda f: expand(f).withColumn("text", F.expr("substring(text, 2)")))
    bad = {r["conv_id"]: r for r in chat.digests(df).collect()}
    assert all(bad[k]["loss_sha256"] != got[k]["loss_sha256"] and bad[k]["formatted_chars"] < got[k]["formatted_chars"] for k in (1, None))


# The whole


def test_pipeline(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = common.table(spark, sf, "documents")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = common.written(stage(spark, docs, sf), name.replace(" ", "-"))
        assert after.columns == columns and after.count() <= docs.count()
        docs = after
    out = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert out.count() == docs.count() and out.where("not round_trip").count() == 0
    left = [(r["doc_id"], r["text"]) for r in docs.collect()]
    shapes = {i: {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} for i, t in left if (w := (t or "").encode().lower().split())}
    ids = list(shapes)
    assert not any(5 * len(shapes[a] & shapes[b]) >= 4 * len(shapes[a] | shapes[b]) for x, a in enumerate(ids) for b in ids[:x])
    items = [_words(r["text"]) for r in common.table(spark, sf, "benchmark").collect()]
    grams = {tuple(v[p : p + 10]) for v in items for p in range(max(1, len(v) - 9))}
    assert not any(tuple(w[p : p + 10]) in grams for _, t in left for w in [_words(t)] for p in range(len(w) - 9))
