"""The operators on documents against brute force, with odd rows: nulls, empty and long texts, repeats, extra columns."""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from creditspark.llm import brown, exact_dedup, licenses, mixing, packing, quality, sharding, simhash
from creditspark.llm.queries import tokenizer_path
from creditspark.llm.rows import take_out

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, copy int, score double, _row long"


def _rows():
    long = " ".join(f"w{i % 977}" for i in range(9000))
    body = "one two three four five six seven eight nine ten " * 8
    texts = [
        (1, "plain words in a row, and some more of them"), (2, "plain words in a row, and some more of them"),
        (3, None), (4, ""), (5, "  "), (6, long), (7, long), (8, long + " x"), (9, body), (10, body + "eleven"),
        (11, "MiXeD  Case\tand\x0bodd\x0cwhite\r\nspace "), (12, "é" * 5000), (13, "é" * 5000), (14, "a"), (15, "a b"),
        (None, "plain words in a row, and some more of them"), (None, None), (16, "repeat"), (16, "repeat"), (16, "other"),
        (17, "<|endoftext|> as text"), (18, "\x00 zero"), (19, "x" * 20000),
    ]
    out = [(i, t, None if n % 5 == 0 else "en", None if n % 7 == 0 else f"s{n % 3}", None, 7, 0.5, n)
           for n, (i, t) in enumerate(texts)]
    rng = np.random.default_rng(0)
    words = [f"v{k}" for k in range(300)]
    out += [(100 + n, " ".join(rng.choice(words, 40)), "en", "s0" if n % 2 else "s9", 1, 7, 0.5, n) for n in range(80)]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(_rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def _text(t):
    return "" if t is None else t


def test_exact_groups(docs):
    members = defaultdict(list)
    for r in _rows():
        members[_text(r[1])].append(r[0])
    rank = lambda i: -1 if i is None else i
    for block in (4, 64, 8192):
        got = exact_dedup.group_copies(docs, block=block).collect()
        assert len(got) == len(_rows())
        by_hash = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in members.items()}
        kept = Counter()
        for r in got:
            ids = by_hash[r["text_sha256"]]
            assert r["group_size"] == len(ids) and r["keep_id"] == max(ids, key=rank)
            kept[r["text_sha256"]] += r["kept"]
            assert not r["kept"] or r["doc_id"] == r["keep_id"]
        assert all(kept[h] == 1 for h in by_hash)


def test_exact_groups_of_one_large_group(spark):
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, F.lit("same " * 10)).otherwise(
        F.concat(F.lit("text "), F.col("id") % 50)).alias("text")).repartition(16)
    got = exact_dedup.group_copies(rows, block=8).groupBy("text_sha256").agg(
        F.count("*").alias("n"), F.max("group_size").alias("g"), F.sum(F.col("kept").cast("int")).alias("k")).collect()
    assert len(got) == 51 and all(r["n"] == r["g"] and r["k"] == 1 for r in got)


def test_taking_out_keeps_columns_and_one_repeat(docs):
    out = take_out(docs, exact_dedup.group_copies(docs).select("row_key", "kept"))
    assert out.columns == docs.columns
    got = [(r["doc_id"], r["text"]) for r in out.collect()]
    assert len(got) == len({_text(r[1]) for r in _rows()})
    assert got.count((16, "repeat")) == 1 and got.count((16, "other")) == 1


def _fingerprint(text, shingle=3):
    words = text.encode().lower().split()
    parts = [b" ".join(words[k:k + shingle]) for k in range(max(1, len(words) - shingle + 1))] if words else []
    hashed = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashed) > len(hashed))


@pytest.mark.parametrize("limit", [20_000, 8])
def test_near_duplicates(docs, limit, monkeypatch):
    monkeypatch.setattr(simhash.texts, "PIECE", 1 << 20)
    rows = _rows()
    prints = [_fingerprint(_text(r[1])) for r in rows]
    of = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= 3:
                a, b = of[i], of[j]
                of = [min(a, b) if x in (a, b) else x for x in of]
    smallest = {}
    for r, c in zip(rows, of):
        if r[0] is not None:
            smallest[c] = min(smallest.get(c, r[0]), r[0])
    want = Counter((r[0], f"{p:016x}", smallest.get(c)) for r, p, c in zip(rows, prints, of))
    found = simhash.near_duplicates(docs, limit=limit).collect()
    assert Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in found) == want
    assert len({r["row_key"] for r in found if r["kept"]}) == len(set(of))


def test_long_text_fingerprint_in_pieces(monkeypatch):
    text = " ".join(f"word{i % 501}" for i in range(3000))
    monkeypatch.setattr(simhash.texts, "PIECE", 200)
    assert simhash.fingerprint(text.encode()) == _fingerprint(text)


def test_trie_walk_finds_every_link():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 200, dtype=np.uint64)
    near = np.unique(np.concatenate([base, base ^ (np.uint64(1) << rng.integers(0, 64, 200).astype(np.uint64)),
                                     base ^ np.uint64(7), base ^ np.uint64(0xF00)]))
    u, v = simhash.walk(near, near, True, 0, 0, 3)
    label = np.arange(len(near))
    simhash._unite(label, *(np.searchsorted(near, x) for x in (u, v)))
    want = np.arange(len(near))
    i, j = np.nonzero(np.bitwise_count(near[:, None] ^ near[None, :]) <= 3)
    simhash._unite(want, i, j)
    assert (label == want).all()


def test_mixing_draws_match_hashes(docs):
    weights, rows = {"s0": 3.0, "s2": 0.0}, _rows()
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len(_text(r[1]).encode()) + 1
    weight = {s: weights.get(s, 1.0) for s in sizes}
    rate = {s: weight[s] / sum(weight.values()) * 2.0 * sum(sizes.values()) / sizes[s] for s in sizes}
    want = Counter()
    for r in rows:
        if not rate[r[3]]:
            continue
        draws = max(1, math.ceil(rate[r[3]] / mixing.SPLIT))
        mean, total = rate[r[3]] / draws, 0
        for i in range(1, draws + 1):
            name = "null" if r[0] is None else str(r[0])
            u = int(hashlib.md5(f"mix:{name}:{i}".encode()).hexdigest()[:13], 16) / 2 ** 52
            k, term = 0, math.exp(-mean)
            below = term
            while u >= below and k < 500:
                k += 1
                term *= mean / k
                below += term
            total += k
        for c in range(total):
            want[(r[0], r[1], c)] += 1
    out = mixing.mix(docs, weights, epochs=2.0)
    assert out.columns == [*docs.columns, "copy_2"]
    assert Counter((r["doc_id"], r["text"], r["copy_2"]) for r in out.collect()) == want


def test_mixing_reaches_its_shares(spark):
    rows = spark.range(30_000).select("id", F.concat(F.lit("s"), F.when(F.col("id") % 3 > 0, 0).otherwise(F.col("id") % 5)).alias("source"),
                                      F.lit("some text").alias("text")).withColumnRenamed("id", "doc_id")
    got = {r["source"]: r["n"] for r in mixing.mix(rows, {}).groupBy("source").agg(F.count("*").alias("n")).collect()}
    assert all(abs(n / 30_000 - 1 / len(got)) < 0.01 for n in got.values())


def test_packing_round_trip(docs):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    want = Counter(tuple(tokenizer.encode(_text(r[1]), add_special_tokens=False).ids + [0]) for r in _rows())
    got = packing.pack_documents(docs, tokenizer_path(), 256).collect()
    sequences, documents = defaultdict(list), defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append(r)
        documents[r["doc_id"]].append(r)
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) and r["length"] == len(r["ids"])
        assert r["piece"] == 0 or r["length"] == 256
    for parts in sequences.values():
        at = 0
        for r in sorted(parts, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 256
    one = [sorted(p, key=lambda r: r["piece"]) for i, p in documents.items() if i not in (None, 16)]
    assert all([r["start"] for r in p] == [sum(x["length"] for x in p[:k]) for k in range(len(p))] for p in one)
    told = Counter(tuple(i for r in p for i in r["ids"]) for p in one)
    assert not told - want and sum(told.values()) == len(_rows()) - 5
    assert len(sequences) <= sum(len(r["ids"]) for r in got) // 256 + 2


def test_words_encode_like_whole_texts():
    known = packing.word_ids(tokenizer_path())
    odd = ["", "a  b", " a", "a\n\nb", "a\n b", "a \nb", "x\ty z", "it's I'll 's", "é b c", "\x00 a", "日本 語\nx", "a\t b",
           "a ", "a\n", "\ta  b", "x \x00b", "a\x85b c", " ", "\n", "<|endoftext|> b", "a1b2 ³4"]
    for text in odd + [_text(r[1]) for r in _rows()]:
        assert known.encode(text) == known.whole(text)


def test_letters_and_last_signs_pass_the_splitter():
    import random

    known = packing.WordIds(tokenizer_path())
    splitter, asked = known.split, []
    known.split = lambda text: asked.append(text) or splitter(text)
    plain = "Élan geñí fin.* größer%%% l\nÀ bas' don'"
    assert known.encode(plain) == known.whole(plain) and asked == ["\n"]
    draw = random.Random(1)
    for _ in range(2000):
        words = ["".join(draw.choice("abzA'sdt.!%&éſÀŉ½ªµ×÷²9_`~Ω中\u0301") for _ in range(draw.randint(1, 6))) for _ in range(3)]
        assert known.encode(" ".join(words)) == known.whole(" ".join(words))


def test_words_that_differ_by_signs_share_the_ids_of_their_letters():
    known = packing.WordIds(tokenizer_path())
    merge, asked = known.merge, []
    known.merge = lambda part: asked.append(part) or merge(part)
    text = "größer größer, Vxab%%% größer% Vxab"
    assert known.encode(text) == known.whole(text)
    assert sorted(asked) == sorted(["größer".translate(known.written), "Ġ" + "größer".translate(known.written), "ĠVxab", ",", "%%%", "%"])
    # letters are kept as words only, not a second time as parts
    assert sorted(known.parts) == ["%", "%%%", ","] and set(known) == {"\0größer", "größer", "größer,", "größer%", "Vxab", "Vxab%%%"}


def test_swaps_empty_a_bin():
    # 3 for 2 with the first bin, then the 2 moves to the second
    better = packing.improve([[0, 1], [2, 3], [4]], [7, 2, 6, 2, 3], 10)
    assert sorted(map(sorted, better)) == [[0, 4], [1, 2, 3]]
    rng = np.random.default_rng(3)
    sizes = rng.integers(1, 2048, 800).tolist()
    packed = packing.pack_sizes(sizes, 2048)
    assert sorted(i for b in packed for i in b) == list(range(800))
    assert all(sum(sizes[i] for i in b) <= 2048 for b in packed)


def test_pairs_of_any_two_pieces_empty_a_bin():
    # twenty small pieces of sizes of their own come first; only the pair at the end fills the other bin
    small = [2 * k + 2 for k in range(20)]
    sizes = small + [101, 104, 1000 - 205]
    bins = [list(range(22)), [22]]
    assert sum(sizes[i] for i in bins[0]) <= 1000
    offers = packing._offers(bins[0], sizes)
    assert (20, 21) in offers and len(offers) == 22 + 22 * 21 // 2
    assert packing._offers([0, 1, 2], [5, 5, 7]) == [(0,), (2,), (0, 2), (0, 1)]


def test_sharding_follows_the_tree(docs):
    tree, grown = sharding.regular_tree(16), sharding.regular_tree(17)

    def draw(nodes, node, key):
        def value(child):
            u = int(hashlib.md5(f"shard:{key}:{child}".encode()).hexdigest()[:13], 16) / 2 ** 52
            return -math.log(u + 2.0 ** -54) / nodes[node][child]
        return min(nodes[node], key=value)

    def leaf(t, key):
        nodes, node = sharding._children(t), ""
        for _ in range(3):
            node = draw(nodes, node, key)
        return int(node.rsplit("/", 1)[1])

    got = sharding.shard_documents(docs, tree, grown).collect()
    assert len(got) == len(_rows())
    slots = defaultdict(list)
    for r in got:
        key = "null" if r["doc_id"] is None else str(r["doc_id"])
        assert (r["shard"], r["grown_shard"]) == (leaf(tree, key), leaf(grown, key))
        assert r["grown_shard"] in (r["shard"], 16)
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    want = Counter((r[0], len(_text(r[1]).encode()) + 1, zlib.crc32(_text(r[1]).encode())) for r in _rows())
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want


def test_weights_move_rows_only_where_they_change(spark):
    tree = sharding.regular_tree(16)
    heavier = [sharding.Shard(s.number, s.region, s.rack, 3.0 if s.number == 5 else s.weight) for s in tree]
    keys = spark.range(4000).select(F.col("id").cast("string").alias("k"))
    both = sharding.place(sharding.place(keys, tree, F.col("k"), "one"), heavier, F.col("k"), "two")
    moved = both.filter("one <> two").collect()
    changed = "region-0/rack-1/"
    assert moved and all(r["two"].startswith("region-0/") for r in moved)
    assert all(r["two"].startswith(changed) for r in moved if r["one"].startswith("region-0/"))
    share = both.filter(F.col("two").endswith("/5")).count() / 4000
    assert abs(share - 3 / 18) < 0.03


def test_quality_separates_held_out_rows(spark):
    rng = np.random.default_rng(5)
    words = ["".join(rng.choice(list("abcdefghij"), 5)) for _ in range(200)]
    rows = []
    for n in range(600):
        text = " ".join(rng.choice(words, 30))
        rows.append((n, text if n % 4 else text.replace(" ", " | "), int(n % 4 > 0)))
    docs = spark.createDataFrame([(r[0], r[1], 1.0) for r in rows] + [(None, None, 2.0), (1000, "", 3.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(r[0], r[2], 0) for r in rows], "doc_id long, quality int, toxic int")
    got = quality.score_quality(docs, labels, keep=["doc_id", "score"])
    assert got.columns == ["doc_id", "score", "held_out", "score_2", "predicted"]
    found = {r["doc_id"]: r for r in got.collect()}
    assert len(found) == 602
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 3 == 1]
    assert all(found[r[0]]["held_out"] for r in held)
    assert np.mean([found[r[0]]["predicted"] == r[2] for r in held]) > 0.97
    assert all(0 <= r["score_2"] <= 1 and r["predicted"] == int(r["score_2"] >= 0.5) for r in found.values())


def test_quality_reads_long_texts_alike_however_cut(monkeypatch):
    rows = [_text(r[1]) for r in _rows()] + ["a b a", " ".join(f"w{i % 97}, {i % 13}" for i in range(3000))]
    column = pa.array([*rows, None])
    table = np.random.default_rng(1).normal(size=(quality.BUCKETS, quality.WIDTH)).astype(np.float32)

    def read():
        sums = np.zeros((quality.BUCKETS, quality.WIDTH), np.int64)
        for batch in quality.context_rows(iter([pa.record_batch([column], ["text"])])):
            np.add.at(sums, batch.column(0).to_numpy(), np.array(batch.column(1).to_pylist()))
        return sums, quality.pool(column, table)

    sums, pooled = read()
    # by hand: every word beside those up to two places away in its own text
    want = np.zeros_like(sums)
    for at in range(len(column)):
        for _, words in quality._words(column[at:at + 1]):
            index = quality.INDEX[quality._draw(words)].astype(np.int64)
            for i, word in enumerate(words):
                for j in range(max(0, i - 2), min(len(words), i + 3)):
                    want[int(word) % quality.BUCKETS] += index[j] * (j != i)
    assert (sums == want).all()
    cut = quality.texts.pieces
    monkeypatch.setattr(quality.texts, "pieces", lambda data, ends: cut(data, ends, 61))
    monkeypatch.setattr(quality, "AT_ONCE", 7)
    again, pooled_again = read()
    assert (again == sums).all() and np.allclose(pooled, pooled_again, atol=1e-4)


def test_quality_without_labels(docs):
    labels = docs.sparkSession.createDataFrame([], "doc_id long, quality int")
    got = quality.score_quality(docs, labels).collect()
    assert len(got) == len(_rows()) and {r["score"] for r in got} == {0.5}


def test_language_model_counts(docs, monkeypatch):
    counts, texts = Counter(), []
    for r in _rows():
        words = [*_text(r[1]).encode().lower().split(), b""]
        held = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 2
        texts.append((r[0], held, words))
        if not held:
            counts.update(words)
    total, kinds = sum(counts.values()), len(counts)
    want = Counter()
    for i, held, words in texts:
        base = sum(math.log10((counts[w] + 1) / (total + kinds + 1)) for w in words)
        want[(i, held, len(words), sum(counts[w] > 0 for w in words), total, round(base, 6))] += 1
    for settings, piece in (({}, 1 << 20), ({"heavy": 40, "units": 20, "classes": 5}, 1 << 20)):
        monkeypatch.setattr(brown.texts, "PIECE", piece)
        got = brown.score_texts(docs, **settings).collect()
        assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6))
                       for r in got) == want
        assert all(r["score"] < 0 for r in got)


def _texts_of_a_language(n=120):
    rng = np.random.default_rng(11)
    words = ["".join(rng.choice(list("abcdefgh"), rng.integers(2, 8))) for _ in range(400)]
    share = 1 / np.arange(1, 401)
    return [" ".join(rng.choice(words, 60, p=share / share.sum())) + "." for _ in range(n)]


def test_brown_scores_are_the_model_s(spark):
    """The joined scores against a walk over every token with the fitted model and the word counts."""
    rows = list(enumerate(_texts_of_a_language()))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    settings = {"heavy": 60, "units": 25, "classes": 4}
    got = {r["doc_id"]: r["score"] for r in brown.score_texts(docs, **settings).collect()}
    learnt = docs.select("text", (F.crc32(F.col("doc_id").cast("string")) % 7 != 2).alias("train"))
    counts = brown.word_counts(learnt)
    n = {np.int64(r["word"]).view(np.uint64): r["n"] for r in counts.collect()}
    model = brown.fit(learnt, counts, **settings)
    import pyarrow as pa

    for i, text in rows[::9]:
        total, before = 0.0, model.units.end
        for _, word, spelling in brown.spelled(pa.array([text]), model.letters):
            for w, s, unit in zip(word, spelling, model.units.look_up(word)[1]):
                total += model.step(np.array([before]), np.array([unit]))[0]
                if unit >= model.units.single:
                    shape = unit - model.units.single
                    total += np.log10((n[w] - brown.DISCOUNT) / model.shape_n[shape]) if n.get(w) else model.unseen[shape] + s
                before = unit
        assert got[i] == pytest.approx(total, abs=1e-9)
    # what words of a shape emit sums to one: the seen ones, and the unseen ones together
    for shape in {int(w) & 31 for w in n} - {0}:
        seen = [c for w, c in n.items() if int(w) & 31 == shape and model.units.look_up(np.array([w]))[1][0] >= model.units.single]
        if seen:
            assert sum(c - brown.DISCOUNT for c in seen) / model.shape_n[shape] + 10 ** model.unseen[shape] == pytest.approx(1)


def test_brown_prefers_words_to_gibberish(spark):
    rng = np.random.default_rng(12)
    known = _texts_of_a_language(150)
    rare = " ".join(sorted({w for t in known for w in t.rstrip(".").split()}, key=lambda w: sum(t.split().count(w) for t in known))[:60])
    odd = ["".join(rng.choice(list("qwxzvkjy"), 6)) for _ in range(60)]
    docs = spark.createDataFrame([*enumerate(known), (2, rare), (9, rare), (1004, " ".join(odd))], "doc_id long, text string")
    rows = brown.score_texts(docs, units=25, classes=4).collect()
    each = {r["doc_id"]: r["score"] / r["n_tokens"] for r in rows if r["doc_id"] > 200}
    rare_score = min(r["score"] / r["n_tokens"] for r in rows if r["n_tokens"] == 61 and r["doc_id"] in (2, 9))
    assert each[1004] < rare_score - 1
    perplexity = lambda held: 10 ** -(sum(r["score"] for r in rows if r["held_out"] == held and r["doc_id"] != 1004)
                                      / sum(r["n_tokens"] for r in rows if r["held_out"] == held and r["doc_id"] != 1004))
    assert perplexity(True) >= perplexity(False) * 0.98


def test_exchange_finds_two_classes():
    bigrams = np.zeros((6, 6))
    bigrams[:3, 3:], bigrams[3:, :3] = 50, 40
    classes = brown.exchange_classes(bigrams, 2)
    assert len(set(classes[:3])) == 1 and len(set(classes[3:])) == 1 and classes[0] != classes[3]


def test_exchange_gains_are_likelihood_gains(monkeypatch):
    bigrams = np.random.default_rng(6).integers(0, 30, (9, 9)).astype(float)

    def likelihood(classes):
        member = np.eye(3)[classes]
        table = member.T @ bigrams @ member
        return sum(brown._xlogx(x).sum() * sign for x, sign in ((table, 1), (table.sum(0), -1), (table.sum(1), -1)))

    order = np.argsort(-bigrams.sum(0), kind="stable")
    now = np.empty(9, int)
    now[order] = np.arange(9) % 3
    for sweeps in range(1, 6):
        for w in order:  # the same moves, each judged by the whole likelihood
            tried = [likelihood(np.where(np.arange(9) == w, c, now)) for c in range(3)]
            if max(tried) > tried[now[w]] + 1e-9:
                now[w] = int(np.argmax(tried))
        assert (brown.exchange_classes(bigrams, 3, sweeps) == now).all()


def test_units_emit_probabilities_that_sum_to_one():
    rng = np.random.default_rng(2)
    words = np.sort(rng.integers(1, 1 << 60, 30, dtype=np.uint64))
    table = brown.Units(words, np.arange(30, 0, -1), 10)
    bigrams = rng.integers(0, 9, (table.total, table.total)).astype(float)
    classes = brown.exchange_classes(bigrams, 4)
    member = np.eye(4)[classes]
    model = brown.Model(table, member.T @ bigrams @ member, classes, bigrams.sum(0), {}, np.zeros(32), 10, 10, np.zeros(257))
    units = np.arange(table.total)
    for before in (0, 3, table.total - 1):
        assert abs(np.sum(10 ** model.step(np.full(len(units), before), units)) - 1) < 1e-9


def test_every_frequent_word_gets_the_class_of_its_contexts(spark, monkeypatch):
    rng = np.random.default_rng(3)
    share = 1 / np.arange(1, 61)
    draw = lambda kind: f"{kind}{'abcdefghij'[(k := rng.choice(60, p=share / share.sum())) % 10]}{'klmnop'[k // 10]}"
    texts = [" ".join(draw("vs"[i % 2]) for i in range(40)) for _ in range(300)] + ["", None, "x" + " " * 300 + "y"]
    docs = spark.createDataFrame([(t, n % 5 != 0) for n, t in enumerate(texts)], "text string, train boolean").repartition(3).cache()
    counts = brown.word_counts(docs).toPandas().sort_values(["n", "word"], ascending=[False, True])
    words, n = counts["word"].to_numpy(np.int64).view(np.uint64), counts["n"].to_numpy(np.int64)
    head = brown.Units(words, n, 20)
    bigrams = brown.bigram_counts(docs, head, np.arange(head.total))
    classes = brown.exchange_classes(bigrams, 3)
    size = int(classes.max()) + 1
    want = Counter()
    name = {}
    for t, train in ((_text(t), n % 5 != 0) for n, t in enumerate(texts)):
        tokens = next(brown.stream(pa.array([t])))[1]
        name.update(zip(tokens.tolist(), t.split()))
        units = np.append(head.end, head.look_up(tokens)[1])
        for k, place in enumerate(head.places(tokens)):
            if train and units[k + 1] >= head.single and tokens[k] != brown.END:
                want[place, classes[units[k]]] += 1
                want[place, size + classes[units[k + 2]]] += 1
    for piece in (1 << 20, 50):
        cut = brown.texts.pieces
        monkeypatch.setattr(brown.texts, "pieces", lambda data, ends, p=piece: cut(data, ends, p))
        found = [b for batch in [[pa.record_batch([[t], [n % 5 != 0]], ["text", "train"])] for n, t in enumerate(texts)]
                 for b in brown.count_contexts(batch, head, classes)]
        monkeypatch.setattr(brown.texts, "pieces", cut)
        got = Counter()
        for b in found:
            for key, times in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                got[key // (2 * size), key % (2 * size)] += times
        assert got == want
    got = {(r["place"], r["cell"]): r["n"] for r in brown.context_counts(docs, head, classes).collect()}
    assert got == want
    of = brown.spread_classes(docs, head, bigrams, classes)
    every = brown.Units(words, n, len(words) + 1)
    assert len(of) == every.total
    # words of one kind that were met often share their classes with no word of the other kind
    often = {k: {of[i] for i, w in enumerate(every.words.tolist()) if name.get(w, "")[:1] == k and every.counts[i] >= 20} for k in "vs"}
    assert often["v"] and often["s"] and not often["v"] & often["s"]
    table = brown.bigram_counts(docs, every, of)
    assert table.sum() == n.sum()


def test_licenses(spark):
    notice = licenses.TEMPLATES["MIT"][2]
    rows = [(1, "Some words. " + notice + " More words."), (2, notice.replace("charge", "cost").upper()), (3, "released under the mit license"),
            (4, "released under a license"), (None, None), (5, ""), (6, " ".join(notice.split()[:12])), (7, "Licensed under CC BY-NC 4.0."),
            (8, "filler " * 400_000 + notice + " filler" * 1000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r["doc_id"], r["license"]): r for r in licenses.scan_licenses(docs).collect()}
    assert set(got) == {(1, "MIT"), (2, "MIT"), (3, "MIT"), (7, "CC-BY-NC-4.0"), (8, "MIT")}
    first = got[1, "MIT"]
    assert first["containment"] == 1 and rows[0][1].encode()[first["begin"]:first["end"]].decode() == notice.rstrip(".")
    assert 0.8 <= got[2, "MIT"]["containment"] < 1 and got[8, "MIT"]["containment"] == 1


def test_band_settings():
    bands = licenses.bands_for(0.6, 0.999, 2)
    assert 1 - (1 - 0.6 ** 2) ** bands >= 0.999 > 1 - (1 - 0.6 ** 2) ** (bands - 1)


def test_empty_tables(empty, spark):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    for df in (exact_dedup.group_copies(empty), simhash.near_duplicates(empty), mixing.mix(empty, {}),
               packing.pack_documents(empty, tokenizer_path()), quality.score_quality(empty, labels), brown.score_texts(empty),
               licenses.scan_licenses(empty), sharding.shard_documents(empty, sharding.regular_tree(16), sharding.regular_tree(17))):
        assert df.count() == 0
