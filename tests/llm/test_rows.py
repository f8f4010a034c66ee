"""Row-wise operators against plain restatements of their contracts."""

import hashlib
import random
import re
import time
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from cartlight.llm import byte_bpe, lm_scoring, quality_classifier, quality_rules, url_filter
from cartlight.llm.queries import RANKS
from tests.llm.conftest import ROWS

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    words = WORD.findall(text or "")
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    twice = {w for w, n in Counter(windows).items() if n > 1}
    repeat = len({i + k for i, w in enumerate(windows) if w in twice for k in range(5)})
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    failed = len(words) < 10 or 100 * repeat > 20 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), repeat, failed


def test_quality_rules(docs_of):
    rng = random.Random(1)
    rows = ROWS + [(100 + i, " ".join(rng.choice(["a", "b", "cc", "d\n", "e|", "#"]) for _ in range(rng.randint(0, 90)))) for i in range(60)]
    got = quality_rules.quality_rules(docs_of(rows)).collect()
    assert len(got) == len(rows) and "KEPT" not in got[0].asDict()
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base(r.text)
        assert not (r.kept and r.base_failed)
    by_id = {r.doc_id: r for r in got}
    assert by_id[5].kept and by_id[5].clean_text == by_id[5].text
    assert not by_id[8].kept and by_id[8].clean_text == ""


def test_lines_are_removed_first():
    good = "The river was high that year, and the bridge could not be crossed by anyone.\nThey waited for three days."
    n_removed, share, text = quality_rules.judge("Home | News | About | Login\n" + good + "\nAll rights reserved.", quality_rules.LineRules())[-3:]
    assert (n_removed, text) == (2, good) and 0.6 < share < 1


def test_repeated_words_of_a_large_vocabulary():
    words = [str(i) for i in range(7000)] + list("abcde") * 2
    assert quality_rules.repeated_words(words) == 10


def test_urls(spark):
    rows = [(1, None), (2, "no mark"), (3, "http://A.Com"), (4, "https://x.COM/a?b"), (5, "http://www.example.com/en/1"), (6, "http://m.example.com/en/1#t"), (7, "http://example.com/fr/"), (8, "http://a.net/es/1"), (9, "http://b.net/de/x?y"), (10, "://net/fr/")]
    got = {r.page_id: r for r in url_filter.filter_urls(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert [(got[i].host, got[i].path) for i in (1, 2, 3, 4)] == [("", ""), ("", ""), ("a.com", ""), ("x.com", "/a")]
    assert [got[i].rule for i in range(1, 11)] == [None, None, None, "com/", "www.example.com/en/", "example.com/en/", "com/", "net/es/", None, "net/fr/"]
    assert [got[i].verdict for i in (4, 5, 6, 7, 8, 10)] == ["allow", "allow", "block", "allow", "block", "block"]


def test_url_model_on_unseen_hosts():
    weights = url_filter.fit(url_filter.LABELLED)
    score = lambda h, p: url_filter.score(url_filter.ngrams(h, p), weights)
    assert score("royal-casino-poker.biz", "/bonus") > 0 > score("www.library.edu", "/courses/history")
    assert not url_filter.fit([]).any()


def test_classifier_on_held_out_ratings(spark, tables):
    docs, labels = tables.documents, tables.labels
    rated = labels.select("doc_id", quality_classifier.grade_of(F.col("quality"), F.col("toxic")).alias("grade"))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    big = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = quality_classifier.train(big[0], big[1].filter("doc_id % 3 > 0").select("doc_id", quality_classifier.grade_of(F.col("quality"), F.col("toxic")).alias("grade")))
    assert (np.diff(model.thresholds) > 0).all()
    judged = quality_classifier.classify(big[0], model).join(big[1].filter("doc_id % 3 = 0"), "doc_id")
    right = judged.select(F.avg((F.col("kept") == ((F.col("quality") == 1) & (F.col("toxic") == 0))).cast("int"))).first()[0]
    assert right > 0.95
    assert quality_classifier.classify(docs, quality_classifier.train(docs, rated.filter("grade = 2"))).filter("not kept").count() == 0


def test_classifier_edges(docs_of, spark):
    docs = docs_of(ROWS)
    grades = spark.createDataFrame([(i, g) for i, g in [(1, 0), (5, 2), (5, 1), (8, 1), (None, 2), (4, None), (99, 7), (6, 2)]], "doc_id long, grade int")
    got = quality_classifier.classify(docs, quality_classifier.train(docs, grades)).collect()
    assert len(got) == len(ROWS) and all(0 <= r.p_tail <= 1 for r in got)
    assert quality_classifier.train(docs.limit(0), grades) is None


@pytest.fixture(scope="module")
def reference_encoder():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.load_ranks(RANKS), special_tokens={})


@pytest.mark.parametrize("head", [byte_bpe.HEAD, 3, 0])
def test_byte_bpe(docs_of, reference_encoder, head):
    rows = [*ROWS, (30, "xqzjv " + "q" * 300 + " xqzjv-unfoldable zzyzx"), (31, "zzyzx"), (32, "zzyzx zzyzx")]
    got = byte_bpe.encode_texts(docs_of(rows), RANKS, public_tokenizers.PATTERN, head=head).withColumn("back", byte_bpe.decode_ids(F.col("ids"), RANKS)).collect()
    assert len(got) == len(rows) and "KEPT" in got[0].asDict()
    for r in got:
        assert r.ids == reference_encoder.encode_ordinary(r.text or "") and r.n_tokens == len(r.ids)
        assert bytes(r.back) == (r.text or "").encode() and np.frombuffer(r.ids_le, "<u4").tolist() == r.ids


def test_byte_bpe_folds_a_word_once_whatever_is_read(docs_of):
    """A text of other words only: ids alone cost no more than all results, where every run of ids folded all its words."""
    rng = random.Random(1)
    docs = docs_of([(1, " ".join("".join(rng.choice("bcdfgxz") for _ in range(12)) for _ in range(1200)))])
    took = []
    for columns in (["ids_le"], ["ids", "ids_le"], ["n_tokens"]):
        start = time.time()
        byte_bpe.encode_texts(docs, RANKS, public_tokenizers.PATTERN, head=0).select(*columns).collect()
        took.append(time.time() - start)
    assert took[2] < 3 * took[1] + 4


def test_encoder_on_random_texts(reference_encoder):
    ranks = byte_bpe.load_ranks(RANKS)
    encoder = byte_bpe.Encoder(ranks, public_tokenizers.PATTERN, {" the": byte_bpe.pack([ranks[b" the"]])})
    rng = random.Random(2)
    signs = [*"ab cde'  \n\t\r\x1c\x85\xa0é中😀12٣.,!<|", " the", "'ll ", "\n\n", " "]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 40))) for _ in range(1500)]
    for text in [*texts, "a" * 1500, " " * 900 + "x", "ab" * 700, "中" * 400]:
        ids, others = encoder.encode(text)
        ids = [x for i in np.frombuffer(ids, "<i4").tolist() for x in ([i] if i >= 0 else byte_bpe.merge_long(others[-1 - i], ranks))]
        assert ids == reference_encoder.encode_ordinary(text) and len(set(others)) == len(others)


def test_fold_of_higher_order_functions(spark, reference_encoder):
    ranks = byte_bpe.load_ranks(RANKS)
    rng = random.Random(4)
    words = ["a", " the", "unbelievable", "étranger", "zzzzzzzz", "12345", "😀!", "ab" * 90, *("".join(rng.choice("aeinrst éß中") for _ in range(rng.randint(1, 25))) for _ in range(300))]
    df = spark.createDataFrame([(w, list(w.encode())) for w in words], "w string, b array<int>")
    got = df.select("w", byte_bpe.let(byte_bpe.rank_literal(byte_bpe.rank_tables(ranks)), lambda t: byte_bpe.encode_word(F.col("b"), t)).alias("ids")).collect()
    for r in got:
        assert r.ids == reference_encoder._encode_single_piece(r.w.encode()) == byte_bpe.merge_long(r.w.encode(), ranks)


def test_encoder_on_many_texts_at_once(reference_encoder):
    """Texts of one batch share what is looked up; words beyond the head come as states, each once a text."""
    ranks = byte_bpe.load_ranks(RANKS)
    words = [w for w in ("the", " the", " Haanth", " é中", "'s") if w.encode() not in ranks or w == " the"]
    encoder = byte_bpe.Encoder(ranks, public_tokenizers.PATTERN, {w: byte_bpe.pack(byte_bpe.merge_long(w.encode(), ranks)) for w in words})
    rng = random.Random(8)
    signs = [*"ab \n.é中😀", " the", " Haanth", " zzyzxq", "  ", " don't", " " + "q" * 250]
    texts = [None, "", " ", "zzyzxq zzyzxq", *("".join(rng.choice(signs) for _ in range(rng.randint(0, 30))) for _ in range(800)), ""]
    runs, raw, which, numbers, others = encoder.encode_all(pa.array(texts, pa.string()))
    numbers = iter(numbers)
    for text, run, le, places in zip(texts, runs.to_pylist(), raw.to_pylist(), which.to_pylist()):
        listed = [others[next(numbers)] for _ in range(max(places, default=-1) + 1)]
        assert len(set(listed)) == len(listed) and [np.frombuffer(b, "<i4").tolist() for b in le] == run and len(run) == len(places) + 1
        ids = [i for k, r in enumerate(run) for i in [*r, *(byte_bpe.merge_long(listed[places[k]], ranks) if k < len(places) else [])]]
        assert ids == reference_encoder.encode_ordinary(text or "")
    assert next(numbers, None) is None


def test_head_compares_words_that_hash_alike(monkeypatch):
    words = [b"a", b"", b" the", "é中".encode(), b"a" * 300]
    take = lambda ws: pa.array(ws, pa.binary())
    head = byte_bpe.Head(take(words), np.arange(5, dtype=np.int32), np.ones(5, np.int64))
    assert head.find(take([b"b", *words[::-1], b" thf", b"a" * 299]).slice(1)).tolist() == [4, 3, 2, 1, 0, -1, -1]
    assert head.find(take([])).tolist() == [] and byte_bpe.Head(take([]), np.empty(0, np.int32), np.empty(0, np.int64)).find(take([b"a"])).tolist() == [-1]
    monkeypatch.setattr(byte_bpe.Head, "hashed", staticmethod(lambda raw, begins, lengths: np.zeros(len(lengths), np.uint64)))
    alike = byte_bpe.Head(take(words), np.arange(5, dtype=np.int32), np.ones(5, np.int64)).find(take([b"b", *words, b"x"])).tolist()
    assert alike[0] == alike[-1] == -1 and all(got in (-1, k) for k, got in enumerate(alike[1:-1])) and max(alike) >= 0


def test_lm_scores_both_sides(docs_of):
    rng = random.Random(3)
    texts = [" ".join(x for _ in range(40) for x in rng.choice([("red", "apple", "tree"), ("blue", "whale", "sea")])) for _ in range(60)]
    docs = docs_of([(i, t) for i, t in enumerate(texts)])
    model = lm_scoring.train(docs, rounds=4, every=2)
    probe = docs_of([(1, "red apple tree red apple tree"), (2, "apple sea whale tree blue red"), *((10 + (i or 0), t) for i, t in ROWS)])
    got = {r.doc_id: r for r in lm_scoring.score(probe, model).collect()}
    assert got[1].mean_log_probability > got[2].mean_log_probability
    assert got[11].n_words == 0 and got[11].log_probability == 0 and got[11].mean_log_probability is None
    # brute force: every word from its own window alone
    numbers = lm_scoring.Numbers({w: i for i, w in enumerate(model.words)})
    flat, at, _ = lm_scoring.stream(["red apple tree red apple tree"], numbers)
    alone = sum(lm_scoring.log_probabilities(model.net, flat, at[i : i + 1])[0] for i in range(len(at)))
    assert abs(alone - got[1].log_probability) < 1e-3
    # and from the parameters themselves, word by word
    by_hand = 0.0
    for i in at:
        h = np.tanh(sum(model.net.embed[k][flat[i + shift]] for k, shift in enumerate(lm_scoring.SHIFTS)) + model.net.bias)
        of_class, word = divmod(int(flat[i]), lm_scoring.PER_CLASS)
        for logits, own in ((h @ model.net.to_class + model.net.class_bias, of_class), (h @ model.net.to_word[of_class] + model.net.word_bias[of_class], word)):
            by_hand += logits[own] - np.log(np.exp(logits.astype(np.float64)).sum())
    assert abs(by_hand - got[1].log_probability) < 1e-3
    assert lm_scoring.score(probe.limit(0), lm_scoring.train(probe.limit(0))).count() == 0


def test_digest_columns_of_the_queries(spark):
    from cartlight.llm import queries

    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    for r in queries.op8_byte_bpe(spark, "/root/testdata/sf0.001").collect():
        assert r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()
    for r in queries.op1_quality_rules(spark, "/root/testdata/sf0.001").collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base(docs[r.doc_id])


def test_lm_predicts_words_beyond_the_vocabulary(docs_of, monkeypatch):
    """Every rare word has a probability of its own, unseen ones too, and all of them sum to at most 1."""
    monkeypatch.setattr(lm_scoring, "vocabulary", lambda counts: [b"red", b"apple"])
    texts = ["red apple tree red apple trees red apple treat"] * 30
    model = lm_scoring.train(docs_of(list(enumerate(texts))))
    probe = ["red apple tree", "red apple qzxjkvwqzxjkvw", "red apple teert"]
    got = [r.log_probability for r in sorted(lm_scoring.score(docs_of(list(enumerate(probe))), model).collect(), key=lambda r: r.doc_id)]
    assert got[0] > got[2] > got[1] and got[1] < got[0] - 20
    short = [bytes([a]) for a in range(256)] + [bytes([a, b]) for a in range(256) for b in range(256)]
    assert 0 < np.exp(model.spelling.log_probabilities(short)).sum() < 1
    by_hand = model.spelling.log_probabilities([b"tree"])[0]
    assert abs(by_hand - model.spelling.log_probabilities([b"xx", b"tree", b"y"])[1]) < 1e-9
    # "tr" goes on with e always, "re" with e in two of three words, "ee" with the end in one of two
    assert -3 < by_hand < np.log(1 / 3)


def test_lm_trains_on_every_word(docs_of, monkeypatch):
    """The parameters of the query make each word of each text a target once, however the texts are dealt to batches."""
    rounds, seen = [], []
    texts = ["a", "b c", "d e f g h", "", "i j k", "l " * 37]
    docs = docs_of(list(enumerate(texts)))
    with monkeypatch.context() as patch:
        patch.setattr(lm_scoring, "_train_round", lambda numbered, net, every, turn: rounds.append((every, turn)) or net)
        lm_scoring.train(docs)
    numbers = lm_scoring.Numbers({w: i for i, w in enumerate(sorted({w for t in texts for w in lm_scoring.split_words(t)}))})
    monkeypatch.setattr(lm_scoring, "train_step", lambda net, squares, flat, at, rate: seen.extend(flat[at].tolist()))
    for i, (every, turn) in enumerate(rounds):
        dealt = [texts] if i % 2 else [texts[:3], texts[3:]]
        lm_scoring.train_copy(lm_scoring.Network.fresh(1), (lm_scoring.stream(x, numbers) for x in dealt), every, turn)
    assert Counter(seen) == Counter(numbers[w] for t in texts for w in lm_scoring.split_words(t))


def test_lm_quality_with_the_parameters_of_the_query(docs_of):
    rng = random.Random(3)
    draw = lambda n: " ".join(x for _ in range(n) for x in rng.choice([("red", "apple", "tree"), ("blue", "whale", "sea")]))
    model = lm_scoring.train(docs_of([(i, draw(40)) for i in range(1500)]))
    held_out = [draw(40) for _ in range(20)]
    mixed = [" ".join(rng.sample(t.split(), 120)) for t in held_out]
    got = {r.doc_id: r.mean_log_probability for r in lm_scoring.score(docs_of(list(enumerate(held_out + mixed))), model).collect()}
    assert all(got[i] > got[20 + i] + 0.3 for i in range(20))


def test_variety_of_long_texts():
    """Repetitive texts are told from varied ones at any length, and the share does not fall with the length."""
    shape = lambda words: {k for k in range(11) if quality_classifier.bucket(f"s:variety:{k}") in quality_classifier.features(" ".join(words))}
    for n in (150, 399, 400, 5000):
        varied = [f"w{i % 1000}" for i in range(n)]
        assert shape(varied) == {0} and shape([f"w{i % 20}" for i in range(n)]) == {8 if n == 150 else 9 if n % 200 == 0 else 8}


def test_lm_trains_and_scores_in_one_call(docs_of):
    """The same numbers as training and scoring apart, with clashing names, repeated rows and rare words; an empty table stays empty."""
    rng = random.Random(6)
    texts = [" ".join(rng.choice(["red", "apple", "tree", "blue", f"w{rng.randint(0, 9000)}"]) for _ in range(rng.randint(0, 60))) for _ in range(150)]
    docs = docs_of([*((i, t) for i, t in enumerate(texts)), (3, texts[3]), *((1000 + (i or 0), t) for i, t in ROWS)]).coalesce(1)
    named = docs.withColumn("N_Words", F.lit(-1)).withColumn("c0", F.lit("x")).withColumn("lm ids", F.lit(0))
    whole = lm_scoring.train_and_score(named)
    assert "N_Words" not in whole.columns and whole.columns[-3:] == ["n_words", "log_probability", "mean_log_probability"]
    apart = lm_scoring.score(docs, lm_scoring.train(docs))
    key = lambda r: (r.doc_id, r.n_words)
    for a, b in zip(sorted(whole.collect(), key=key), sorted(apart.collect(), key=key), strict=True):
        assert (a.doc_id, a.n_words, a.c0, a["lm ids"]) == (b.doc_id, b.n_words, "x", 0)
        assert abs(a.log_probability - b.log_probability) < 1e-3 and (a.mean_log_probability is None) == (b.n_words == 0)
    assert lm_scoring.train_and_score(named.limit(0), keep=["doc_id"]).count() == 0
