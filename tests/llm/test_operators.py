from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from watchglass.llm import bpe, chat, compression, golay, line_dedup, packing, quality_rules, simhash, topk, toxicity, url_filter

TEXTS = ["", "one", "two words", None, "Don't  stop\n\nnow 12 <|endoftext|> ünï Σσς 日本語 é", "a" * 5000, "word " * 3000, " \t\n ", "\x1c odd \x85 space   runs \n \n end ", "😀 mixed CASE Words' and more"]


def documents(spark, texts=TEXTS):
    """Documents with a null id, repeated rows and columns whose names clash with results."""
    rows = [(None if i == 1 else i, t, "x", 7, "y") for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[-1]], "doc_id long, text string, score string, component_id int, rank string")


def empty(spark):
    return documents(spark).filter("false")


def labels(spark, rows=()):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")


# packing


def test_pieces_are_the_tokenizers(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(packing.default_path())
    got = packing.pack_documents(documents(spark), packing.default_path(), with_ids=True).collect()
    by_doc = {}
    for r in got:
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        assert len(ids) == r["length"] <= 2048 and zlib.crc32(bytes(r["ids"])) == r["ids_crc32"]
        by_doc.setdefault(r["doc_id"], {}).setdefault(r["piece"], []).append((r["start"], ids))
    for i, text in enumerate(TEXTS):
        pieces = by_doc[None if i == 1 else i]
        ids = [x for k in sorted(pieces) for x in pieces[k][0][1]]
        assert ids == [*library.encode(text or "", add_special_tokens=False).ids, 0]
        assert all(len(pieces[k][0][1]) == 2048 for k in sorted(pieces)[1:])
    bins = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for items in bins.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.pack_documents(empty(spark), packing.default_path()).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_runs_pack_like_single_pieces(seed):
    rng = random.Random(seed)
    lengths = [rng.choice([rng.randint(1, 50), rng.randint(1, 8)]) for _ in range(400)]
    free = []
    for n in sorted(lengths, reverse=True):  # plain best-fit decreasing
        fits = [i for i, f in enumerate(free) if f >= n]
        if fits:
            free[min(fits, key=lambda i: free[i])] -= n
        else:
            free.append(50 - n)
    intervals, bins = packing.best_fit_decreasing(Counter(lengths), 50)
    assert bins == len(free)
    used = Counter()
    for (length, rank, first, each, offset), following in zip(intervals.tolist(), [*intervals.tolist()[1:], [0]], strict=False):
        stop = following[1] if following[0] == length else Counter(lengths)[length]
        for k in range(stop - rank):
            used[first + k // each] += length
            assert offset + (k % each + 1) * length <= 50
    assert sorted(50 - u for u in used.values()) == sorted(free)


# bpe


def test_bpe_is_the_library(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.default_path())
    rng = random.Random(2)
    texts = [*TEXTS, *("".join(rng.choice("aab'cΣσÉéİß日 \n0١²½!?é\x1c<|endoftext|>") for _ in range(rng.randint(0, 60))) for _ in range(300)), *("".join(rng.choice("abcdeinorst") for _ in range(30)) for _ in range(300))]
    rows = bpe.encode_documents(documents(spark, texts), bpe.default_path(), decoded=True).collect()
    expected = Counter()
    for i, t in enumerate([*texts, texts[-1]]):
        ids = library.encode(t or "", add_special_tokens=False).ids
        expected[(None if i == 1 else min(i, len(texts) - 1), np.array(ids, "<u4").tobytes(), library.decode(ids, skip_special_tokens=False))] += 1
    assert Counter((r["doc_id"], bytes(r["ids"]), r["decoded"]) for r in rows) == expected
    encoded = bpe.encode_documents(documents(spark), bpe.default_path())
    assert bpe.decode_documents(encoded, bpe.default_path()).count() == len(TEXTS) + 1
    assert bpe.encode_documents(empty(spark), bpe.default_path()).count() == 0


# simhash


def test_golay_decodes_every_error_of_three_bits():
    words = np.random.default_rng(0).integers(0, 1 << 23, 500)
    codewords = words ^ golay.corrections()[golay.syndrome(words)]
    assert not golay.syndrome(codewords).any() and np.bitwise_count(codewords ^ words).max() <= 3
    flipped = words ^ (1 << np.random.default_rng(1).integers(0, 23, 500))
    assert all(b in row for row, b in zip(golay.near(words), golay.decode(flipped), strict=True))


def test_links_match_all_pairs(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(-(1 << 63), (1 << 63) - 1, 60)
    prints = {int(x) for x in base}
    for x in base:
        for k in (1, 2, 3, 4, 5):
            y = int(x)
            for bit in rng.choice(64, k, replace=False):
                y ^= 1 << int(bit)
            prints.add((y + (1 << 63)) % (1 << 64) - (1 << 63) if not -(1 << 63) <= y < 1 << 63 else y)
    fps = sorted(prints)
    got = {(r["a"], r["b"]) for r in simhash.links(spark.createDataFrame([(x,) for x in fps], "fp long")).collect()}
    assert got == {(a, b) for i, a in enumerate(fps) for b in fps[i + 1 :] if ((a ^ b) & (1 << 64) - 1).bit_count() <= 3}


def test_near_duplicates(spark):
    text = " ".join(f"w{i}" for i in range(400))
    got = simhash.near_duplicates(documents(spark, [text, "other", text.upper(), "", None, "  ", "a b"])).collect()
    groups = {}
    for r in got:
        groups.setdefault(r["component_id"], []).append(r["doc_id"])
    assert sorted(groups[0]) == [0, 2] and sorted(groups[3]) == [3, 4, 5] and groups[None] == [None] and groups[6] == [6, 6]
    assert simhash.near_duplicates(empty(spark)).count() == 0


# lines


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(row[j] + 1, now[-1] + 1, row[j - 1] + (x != y)))
        row = now
    return row[-1]


def changed(rng, text, times):
    chars = list(text)
    for _ in range(times):
        at = rng.randint(0, len(chars))
        what = rng.randint(0, 2)
        if what == 0:
            chars.insert(at, rng.choice("abé"))
        elif chars:
            at = min(at, len(chars) - 1)
            chars[at : at + 1] = [] if what == 1 else [rng.choice("abé")]
    return "".join(chars)


@pytest.mark.parametrize("edits", [1, 2])
def test_banded_distance(spark, edits):
    rng, pairs = random.Random(edits), []
    for k in range(400):
        a = "".join(rng.choice("abé ") for _ in range(rng.randint(0, 12) if k % 2 else rng.randint(30, 60)))
        pairs.append((a, changed(rng, a, rng.randint(0, 5))))
    rows = spark.createDataFrame(pairs, "a string, b string").select("a", "b", line_dedup.edit_distance(F.col("a"), F.col("b"), edits).alias("d"), line_dedup.counts_near(line_dedup.counts(F.col("a")), line_dedup.counts(F.col("b")), edits).alias("near"))
    for r in rows.collect():
        true = distance(r["a"], r["b"])
        assert min(r["d"], edits + 1) == min(true, edits + 1)
        assert r["near"] or true > edits


@pytest.mark.parametrize(("edits", "chars"), [(2, 8), (2, 2)])
def test_line_dedup_matches_all_pairs(spark, edits, chars):
    """Lines of 1 to 45 characters, against the edit distance of all pairs."""
    rng = random.Random(3)
    base = ["".join(rng.choice("abcdefgh ") for _ in range(n)) for n in [*range(1, 20), 23, 27, 30, 31, 32, 33, 36, 40, 45]]
    docs = [(rng.choice([i, i, i, None]), "\n".join(rng.choice(["", "short line", "  ", rng.choice(base), changed(rng, rng.choice(base), rng.randint(0, 3))]) for _ in range(rng.randint(0, 9))) if i % 7 else None) for i in range(60)]
    docs += docs[:3]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    clashes = {c: F.lit("clash") for c in ("n_near", "_doc", "_mark", "_dropped", "_near", "mark", "dropped", "row", "a.b", "c`d")}
    got = line_dedup.dedup_lines(df.withColumn("src", F.col("text")).withColumns(clashes), edits, chars)
    assert [c for c in got.columns if c in clashes] == [*list(clashes)[1:], "n_near"]
    got = got.collect()
    mark = {(r["doc_id"], r["text"]): r["m"] for r in df.select("doc_id", "text", F.xxhash64("text").alias("m")).collect()}
    place = lambda k, p: (k[0] is None, k[0] or 0, mark[k], p)
    seen = [(place(k, p), line) for k in set(docs) if k[1] is not None for p, line in enumerate(k[1].split("\n")) if re.search("[^ \t-\r]", line)]
    lines = sorted({x[1] for x in seen})
    parent, links = {x: x for x in lines}, 0

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(lines):
        for b in lines[:i]:
            if distance(a, b) <= min(edits, min(len(a), len(b)) // chars):
                parent[find(a)], links = find(b), links + 1
    assert links > 5
    first = {}
    for p, line in sorted(seen):
        first.setdefault(find(line), (p, line))
    for r in got:
        k = (r["doc_id"], r["src"])
        if k[1] is None:
            assert r["text"] is None and r["n_lines"] == 0
            continue
        stays = [line for p, line in enumerate(k[1].split("\n")) if not re.search("[^ \t-\r]", line) or first[find(line)][0] == place(k, p)]
        assert r["text"] == "\n".join(stays)
    assert len(got) == len(docs)


def test_line_dedup_edges(spark):
    """Frequent lines, very long lines and texts, an empty table."""
    assert line_dedup.dedup_lines(empty(spark)).count() == 0
    long_line = "word and " * 3000
    docs = [(i, "one very common line of text\n" * 3 + f"own line number {i * 7919} of this text") for i in range(100)]
    docs += [(1000, long_line), (1001, long_line[:-3] + "or "), (1002, "\n".join(f"{i * i} squares {i}" for i in range(1000)))]
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert sum("common" in r["text"] for r in got.values()) == 1 and got[0]["text"].count("common") == 1
    assert got[1000]["text"] == long_line and got[1001]["text"] == "" and got[1001]["n_near"] == 1
    assert got[1002]["n_lines"] == 1000


@pytest.mark.parametrize("most", [1, 1000])
def test_frequent_keys_join_like_others(spark, monkeypatch, most):
    monkeypatch.setattr(line_dedup, "LEAST_HOT", most)
    monkeypatch.setattr(line_dedup, "SMALL_GROUPS", 0)
    rows = spark.createDataFrame([(k, i) for k in range(6) for i in range(k + 1)] + [(None, 1)], "k long, i int")
    groups = spark.createDataFrame([(k, f"v{k}", k + 1) for k in range(5)], "k long, v string, n int")
    got = line_dedup._joined(rows, ["k"], groups, "v", "n", 20).collect()
    assert sorted((r["k"], r["i"], r["v"]) for r in got if r["k"] is not None) == [(k, i, f"v{k}" if k < 5 else None) for k in range(6) for i in range(k + 1)]
    assert [r["v"] for r in got if r["k"] is None] == [None]


# top k


def test_top_k_matches_all_pairs(spark):
    import math

    rng = np.random.default_rng(0)
    odd = [None, [1.0, None, 2.0, 0.0], [float("nan")] * 4, [float("inf"), 0.0, 0.0, 0.0], [1.0, 2.0], []]
    rows = [(i if i % 11 else (None if i % 3 else 50), [float(x) for x in rng.normal(0, 3, 4)] if i % 7 else odd[i % 6]) for i in range(300)] + [(100, [1.0, 2.0, 3.0, 4.0])] * 40
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"score": F.lit("x"), "rank": F.lit(1)})
    got = sorted(map(tuple, topk.top_k(df, shards=3).collect()))
    usable = [(v, [math.floor(256 * x) for x in e]) for v, e in rows if v is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)]
    expected = []
    for i, (q, e) in enumerate(usable):
        if q % 50 == 0:
            best = sorted((-sum(a * b for a, b in zip(e, f, strict=True)), v) for j, (v, f) in enumerate(usable) if j != i and len(f) == len(e))[:5]
            expected += [(q, k + 1, v, -s) for k, (s, v) in enumerate(best)]
    assert got == sorted(expected)
    assert topk.top_k(df.filter("false")).count() == 0


def block_of(data, first_row, scale=256):
    data = np.asarray(data, float)
    n = len(data)
    kind, raw = topk.encode(data, scale)
    return topk.Block(data.shape[1], kind, np.arange(n).tobytes(), np.arange(first_row, first_row + n).tobytes(), raw, scale)


@pytest.mark.parametrize("size", [3.0, 1e6, 1e17])
def test_phases_resolve_only_what_the_threshold_leaves(size):
    """Lists, cutoff and collected entries of one shard: nothing missed, far fewer scores resolved than there are pairs."""
    rng = np.random.default_rng(1)
    q, v = rng.normal(0, 1, (20, 32)), rng.normal(0, 1, (3000, 32))
    q[0] = 0  # ties throughout
    q, v = q * size, v * (size if size < 1e10 else 1)
    exact = [[sum(topk.whole(a, 256) * topk.whole(b, 256) for a, b in zip(x, y, strict=True)) for y in v.tolist()] for x in q.tolist()]
    lists = topk.Lists(block_of(q, 10**6), block_of(v, 0))
    least = np.full((4, 20), -np.inf, object)
    j, at, score = topk.tops(lists, 5, least)
    assert [exact[a][b] for a, b in zip(j, at, strict=True)] == [int(s) for s in score] and lists.resolved <= 20 * 5 * 4
    cutoff = [sorted((int(s) for s, k in zip(score, j, strict=True) if k == i), reverse=True)[4] for i in range(20)]
    lists = topk.Lists(block_of(q, 10**6), block_of(v, 0))
    j, at, score = topk.collect(lists, cutoff)
    found = {(int(a), int(b)): int(s) for a, b, s in zip(j, at, score, strict=True)}
    assert found == {(i, k): s for i, row in enumerate(exact) for k, s in enumerate(row) if s >= cutoff[i]}
    assert lists.resolved < 20 * 3000 / 2  # one query of 20 ties with all


def test_top_k_of_components_beyond_64_bits(spark):
    rows = [(51, [-1e17, 1.0]), (1, [1e16, 2.0]), (2, [-3.0, 1.0]), (3, [0.0, 0.5]), (4, [1e-300, 7.0]), (100, [0.0, 0.0]), (100, [0.0, 0.0])]
    got = [tuple(r) for r in topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=2, shards=2).filter("query_id = 100").collect()]
    assert sorted(got) == [(100, 1, 1, 0), (100, 1, 1, 0), (100, 2, 2, 0), (100, 2, 2, 0)]
    small = spark.createDataFrame(rows[2:] + [(150, [0.0, 1e12])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in topk.top_k(small, k=1, shards=2).filter("query_id = 150").collect()] == [(150, 1, 4, 7 * 256 * 256 * 10**12)]
    with pytest.raises(Exception, match="[Oo]verflow|too large|too big"):
        topk.top_k(spark.createDataFrame([(50, [1e17]), (1, [1e17])], "vec_id long, embedding array<double>"), shards=2).collect()


# urls


def test_url_rules(spark):
    urls = ["http://A.Example.COM/en/7x?q#f", "https://x.com/en/1", "http://example.com/en", None, "no scheme", "://host", "ftp://example.net/de/81", "http://net/de/", "http://a..org/es/", "http://xcom/en/", "http://b.net?/de/"]
    pages = spark.createDataFrame([(i, u, "r") for i, u in enumerate(urls)] + [(0, urls[0], "r")], "page_id long, url string, rule string")
    got = {r["page_id"]: tuple(r)[1:] for r in url_filter.judge(pages).collect()}
    assert got == {
        0: ("a.example.com", "/en/7x", "example.com/en/7", "allow"), 1: ("x.com", "/en/1", "com/en/", "block"), 2: ("example.com", "/en", None, "allow"), 3: ("", "", None, "allow"), 4: ("", "", None, "allow"),
        5: ("host", "", None, "allow"), 6: ("example.net", "/de/81", "example.net/de/8", "block"), 7: ("net", "/de/", "net/de/", "allow"), 8: ("a..org", "/es/", "org/es/", "block"), 9: ("xcom", "/en/", None, "allow"), 10: ("b.net", "", None, "allow"),
    }
    assert url_filter.judge(pages).count() == len(urls) + 1
    assert url_filter.judge(pages, rules=[], default="block").filter("verdict = 'block'").count() == len(urls) + 1
    assert url_filter.judge(pages.filter("false")).count() == 0


# rules


def test_statistics(spark):
    texts = [*TEXTS, "a b c d e a b c d e f", "x\ny\nx\n \n \nx", "# * $ % & | < > é#", "a b c d e f " * 40, "same " * 20]
    word = re.compile("[^\x20\x09-\x0d]+")
    for r in quality_rules.statistics(documents(spark, texts)).collect():
        text = texts[1 if r["doc_id"] is None else r["doc_id"]] or ""
        words, lines = word.findall(text), [x for x in text.split("\n") if word.search(x)]
        windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
        count = Counter(windows)
        covered = {i + k for i, w in enumerate(windows) if count[w] > 1 for k in range(5)}
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))


def test_decision_list():
    rng = random.Random(0)
    rows = [({"a": rng.random(), "b": rng.random()}, None) for _ in range(600)]
    rows = [(v, v["a"] > 0.8 or (v["a"] < 0.3 and v["b"] < 0.3)) for v, _ in rows]
    rules = quality_rules.learn(rows)
    said = [any(quality_rules._covers(rule, v) for rule in rules) for v, _ in rows]
    assert np.mean([s == t for s, (_, t) in zip(said, rows, strict=True)]) > 0.95
    assert quality_rules.learn([]) == []


def test_rules_without_labels_pass_what_the_base_passes(spark):
    docs = documents(spark, ["word%d " % i * 3 + "some other words that make it long enough %d" % i for i in range(4)])
    assert quality_rules.fit(docs, labels(spark)) == []
    assert quality_rules.apply_rules(docs, []).filter("kept <> (not base_failed)").count() == 0
    assert quality_rules.apply_rules(empty(spark), []).count() == 0


# classifiers


def corpus(seed, n=160):
    """(doc_id, text, quality, toxic): poor texts are full of symbols, toxic ones hold words of one stem."""
    rng, rows = random.Random(seed), []
    syllables = [a + b for a in "bcdfglmnprst" for b in "aeiou"]
    for i in range(n):
        words = ["".join(rng.choice(syllables) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(20, 150))]
        toxic, poor = i % 4 == 0, i % 3 == 0
        if toxic:
            for _ in range(3):
                words.insert(rng.randint(0, len(words)), "zorka" + rng.choice(syllables))
        rows.append((i, " ".join(w + ("$%&" if poor else "") for w in words), int(not poor), int(toxic)))
    return rows


@pytest.mark.parametrize(("module", "label"), [(compression, "quality"), (toxicity, "toxic")])
def test_classifiers_hold_out(spark, module, label):
    rows = corpus(1)
    docs = spark.createDataFrame([(i, t) for i, t, _, _ in rows], "doc_id long, text string")
    known = labels(spark, [(i, q, t) for i, _, q, t in rows])
    model = module.fit(docs, known)
    mark = {i: (q if label == "quality" else t) for i, _, q, t in rows}
    held = [i for i in mark if zlib.crc32(str(i).encode()) % 5 == 0]
    scores = {r["doc_id"]: r["score"] for r in module.score(docs, model).collect()}
    pairs = [(scores[a], scores[b]) for a in held for b in held if mark[a] > mark[b]]
    assert pairs and np.mean([a > b for a, b in pairs]) > 0.95
    odd = module.score(documents(spark), model).collect()
    assert len(odd) == len(TEXTS) + 1 and all(0 <= r["score"] <= 1 for r in odd)
    assert module.with_score(documents(spark), model).columns == ["doc_id", "text", "component_id", "rank", "score"]
    assert module.score(empty(spark), model).count() == 0
    blank = module.fit(docs, labels(spark))
    assert all(0 <= r["score"] <= 1 for r in module.score(docs, blank).collect())


def test_network_gradients():
    class Kept(toxicity._Trainer):
        def _step(self, name, grad, rows=None):
            self.found[name] = grad if rows is None else (rows, grad)

    texts = [["bad", "the", "a"] * 4, ["clean", "words"] * 16, ["short", "one"]]
    net = toxicity._fresh(texts, np.array([1, 0, 1]), 1)
    for name in ("word", "chars", "project", "shift", "recur", "attend", "out"):
        setattr(net, name, getattr(net, name).astype(np.float64))
    trainer, marks, weight = Kept(net), np.array([1.0, 0, 1]), np.ones(3)
    trainer.found = {}
    trainer.batch(texts, marks, weight)
    grads, rng = dict(trainer.found), np.random.default_rng(0)
    for name in ("project", "shift", "recur", "attend", "out"):
        value = getattr(net, name)
        at, keep = tuple(rng.integers(n) for n in value.shape), value.copy()
        losses = []
        for step in (1e-3, -1e-3):
            value[at] = keep[at] + step
            losses.append(trainer.batch(texts, marks, weight))
        value[at] = keep[at]
        assert grads[name][at] == pytest.approx((losses[0] - losses[1]) / 2e-3, rel=1e-2, abs=1e-7)


def test_windows_cover_every_word():
    for n in (0, 1, 31, 32, 33, 48, 100):
        covered = {i for s in toxicity.window_starts(n) for i in range(s, min(n, s + toxicity.WINDOW))}
        assert covered == set(range(n))


# chat


def talk(seed=5, n=30):
    rng, rows = random.Random(seed), []
    for conv in range(n):
        for turn in range(rng.randint(1, 9)):
            rows.append((conv, turn, chat.ROLES[1 + turn % 2], "\n".join(" ".join("w" * rng.randint(1, 9) for _ in range(rng.randint(1, 40 if turn % 2 else 8))) for _ in range(rng.randint(1, 3)))))
    return rows


TALK = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize(("block", "chunk"), [(chat.TURN, 4096), (chat.BLOCK, 2), (50, 3)])
def test_blocks_decode_like_one_pass(spark, monkeypatch, block, chunk):
    monkeypatch.setattr(chat, "CHUNK", chunk)
    rows = talk() + [(None, 0, "user", "x"), (1, None, "user", "x"), (2, 50, None, "x"), (3, 60, "user", None), talk()[0], (4, 100, "tool", "y\nz"), (4, 100, "user", "another text at one place"), (6, -3, "system", "before all")]
    lines = chat.transcripts(spark.createDataFrame(rows, TALK).withColumn("rendered", F.lit(1)))
    if block == 50:  # numbers of any kind, the first of a conversation anywhere
        lines = lines.withColumn("line_no", F.floor(F.col("line_no") / chat.TURN) * 20 + F.col("line_no") % 20 + F.col("conv_id") * 37)
    model = chat.fit(lines, block=block)
    got = {}
    for r in chat.parse(lines, model, block).collect():
        got.setdefault(r["conv_id"], []).append(r)
    true, right, total = {}, 0, 0
    for r in lines.distinct().collect():
        true.setdefault(r["conv_id"], []).append((r["line_no"], r["line"], r["role"], r["begins"]))
    plain = chat.train([[x[1:] for x in sorted(true[k])] for k in sorted(true) if zlib.crc32(str(k).encode()) % 5])
    for a, b in zip((model.start, model.move, model.marker, model.form), (plain.start, plain.move, plain.marker, plain.form), strict=True):
        assert np.allclose(np.exp(a), np.exp(b))
    for conv, known in true.items():
        known.sort()
        e = np.array([model.emission(line, i == 0) for i, (_, line, _, _) in enumerate(known)])
        path = [chat.STATES[s] for s in chat.viterbi(e, model.start, model.move)]
        found = sorted(got.pop(conv), key=lambda r: r["line_no"])
        assert [(r["line_no"], r["role"], r["begins"]) for r in found] == [(no, *p) for (no, *_), p in zip(known, path, strict=True)]
        assert [r["rendered"] for r in found] == [chat.rendered(line, *p) for (_, line, _, _), p in zip(known, path, strict=True)]
        right += sum(p == x[2:] for p, x in zip(path, known, strict=True))
        total += len(known)
    assert not got and right / total > 0.8
    assert chat.parse(lines.filter("false"), model).count() == 0


def test_viterbi_is_the_best_of_all_paths():
    from itertools import product

    rng = np.random.default_rng(4)
    model = chat.train([[(line, role, begins) for line, role, begins in (("User: a", "user", True), ("b", "user", False), ("Assistant: c", "assistant", True))]] * 3)
    for words in (["Q: x"], ["x", "Human: y?", "z"], ["A: long " * 30, "", "Tool: 1", "User: no"]):
        e = np.array([model.emission(w, i == 0) for i, w in enumerate(words)]) + rng.normal(0, 1e-3, (len(words), len(chat.STATES)))
        chance = lambda path: model.start[path[0]] + sum(model.move[a, b] for a, b in zip(path, path[1:], strict=False)) + sum(e[i, s] for i, s in enumerate(path))  # noqa: E731, B023
        assert tuple(chat.viterbi(e, model.start, model.move)) == max(product(range(len(chat.STATES)), repeat=len(words)), key=chance)


def test_rendering_keeps_all_text(spark):
    """Markers go only at a turn's start, and only where they name the role found."""
    rows = [(c, t, role, text) for c in range(40) for t, (role, text) in enumerate([("user", "first question?\nQ: nested line\n"), ("assistant", "answer one\nA: quoted"), ("tool", ""), ("assistant", "x " * 200_000 if c == 0 else "end")])]
    lines = chat.transcripts(spark.createDataFrame(rows, TALK))
    marked = lines.filter((F.crc32(F.col("conv_id").cast("string")) % 4).isin(0, 2))
    model = chat.fit(marked)
    out = {}
    for r in sorted(chat.parse(marked, model).collect(), key=lambda r: r["line_no"]):
        out.setdefault(r["conv_id"], []).append(r["rendered"])
    assert out
    for conv, parts in out.items():
        last = "x " * 200_000 if conv == 0 else "end"
        assert "\n".join(parts) == f"<|user|>\nfirst question?\nQ: nested line\n\n<|assistant|>\nanswer one\nA: quoted\n<|other|>\n\n<|assistant|>\n{last}"
    assert chat.rendered("Q: x", "assistant", True) == "<|assistant|>\nQ: x" and chat.rendered("Q: x", "user", True) == "<|user|>\nx" and chat.rendered("Q: x", "user", False) == "Q: x"


@pytest.mark.parametrize(("line", "role", "rest"), [("User: hi", "user", "hi"), ("### Human: hi", "user", "hi"), ("<|assistant|> x", "assistant", "x"), ("[System] y", "system", "y"), ("Note: z", None, "Note: z"), ("a: b", "assistant", "b"), ("", None, "")])
def test_markers(line, role, rest):
    assert chat.split_marker(line) == (role, rest)
