"""Operators that shuffle, against brute force on small tables."""

import random
import zlib

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from cartlight.llm import chat_format, mixing, near_copies, quality_rules, queries, simhash_golay, token_files, topk_search
from cartlight.llm.components import connected_components
from cartlight.llm.queries import WORD_TOKENIZER
from tests.llm.conftest import ROWS
from tools.check import rows_of

SF = "/root/testdata/sf0.001"


def test_golay_keys_meet_within_four_bits():
    assert sorted(set((simhash_golay.error_patterns() >= 0).sum(axis=1).tolist())) == [1, 6]
    rng = np.random.default_rng(4)
    x = rng.integers(0, 2**64, 3000, dtype=np.uint64)
    y = x.copy()
    for i in range(len(y)):
        for bit in rng.choice(64, 4, replace=False):
            y[i] ^= np.uint64(1 << int(bit))
    keys = set(zip(*(a.tolist() for a in simhash_golay.fuzzy_keys(x))))
    met = {r for r, k in zip(*(a.tolist() for a in simhash_golay.fuzzy_keys(y))) if (r, k) in keys}
    assert len(met) == len(x)


def plain_fingerprint(text):
    words = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()).split()
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components_of(prints):
    names = list(range(len(prints)))
    for i, a in enumerate(prints):
        for j in range(i):
            if bin(a ^ prints[j]).count("1") <= 4:
                old, new = names[i], names[j]
                names = [new if n == old else n for n in names]
    return names


def near(docs_of, rows):
    got = simhash_golay.near_duplicates(docs_of(rows)).collect()
    assert len(got) == len(rows)
    prints = [plain_fingerprint(t) for _, t in rows]
    names = components_of(prints)
    least = {n: min((i for (i, _), m in zip(rows, names) if m == n and i is not None), default=None) for n in set(names)}
    expected = sorted((i is None, i, f"{p:016x}", least[n]) for (i, _), p, n in zip(rows, prints, names))
    assert sorted((r.doc_id is None, r.doc_id, r.fingerprint, r.component_id) for r in got) == expected


def test_near_duplicates(docs_of, monkeypatch):
    rng = random.Random(5)
    start = [str(rng.randint(0, 999)) for _ in range(150)]
    rows = [r for r in ROWS if r[0] != 7]
    for i in range(80):  # a chain of small edits, so that components hold texts that are no direct neighbours
        start[rng.randrange(150)] = "new" + str(i)
        rows.append((200 + i, " ".join(start)))
    near(docs_of, rows)
    assert near(docs_of, []) is None


def test_large_buckets_go_through_variants(spark, monkeypatch):
    rng = np.random.default_rng(6)
    centre = rng.integers(0, 2**63, dtype=np.uint64)
    fps = {int(centre)}
    for _ in range(120):
        x = int(centre)
        for bit in rng.choice(64, rng.integers(1, 5), replace=False):
            x ^= 1 << int(bit)
        fps.add(x)
    rows = spark.createDataFrame([(int(np.uint64(x).astype(np.int64)),) for x in fps], "fp long")
    nodes = connected_components(simhash_golay.variant_links(rows)).collect()
    names = components_of(list(fps))
    largest = max(names.count(n) for n in set(names))
    groups = {}
    for r in nodes:
        groups.setdefault(r.component, set()).add(r.node)
    assert max(map(len, groups.values())) == largest


def test_forest_and_runs():
    fp = np.array([0, 1, 3, 2**60, 2**60 + 1, 2**40 - 1], dtype=np.int64)
    assert sorted(simhash_golay.forest(fp)) == [(1, 0), (2, 0), (3, 0), (4, 0)]
    a, b, over = simhash_golay.bucket_links(np.zeros(6, dtype=np.int64), fp)
    assert not over and {(int(x), int(y)) for p, q in zip(a, b) for x, y in zip(p, q)} >= {(1, 0), (2**60 + 1, 2**60)}


def test_components(spark):
    links = [(1, 2), (2, 3), (3, 4), (10, 9), (9, 8), (5, 5), (7, None), (2, 1), *((100 + i, 101 + i) for i in range(40))]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**dict.fromkeys([1, 2, 3, 4], 1), **dict.fromkeys([8, 9, 10], 8), **dict.fromkeys(range(100, 141), 100)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_words_of_plain_letters_skip_the_steps_before_the_merges():
    """Same ids as the library's for every kind of word; only words with other characters go through all its steps."""
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(WORD_TOKENIZER)
    texts = ["Stra\u00dfe \u00c9COLE na\u00efve, caf\u00e9! (don't) 2024 a-b \u00ad \u0130x e\u0301t\u00e9 \u00e6\u00f8\u00e5 z\u00f7a \u0917\u093c <|endoftext|> Word.", None, "word " * 3 + "WORD?!"]
    with open(WORD_TOKENIZER, encoding="utf-8") as source:
        ours = token_files.WordTokenizer(source.read())
    asked, whole = [], ours.parts.whole
    ours.parts.whole = lambda word: asked.append(word) or whole(word)
    got = [ids.tolist() for ids in ours.encode_batch(texts, 1)]
    assert got == [[*library.encode(t or "", add_special_tokens=False).ids, 1] for t in texts]
    assert asked and not any(token_files.PLAIN.fullmatch(word) for word in asked)


def test_token_files(docs_of):
    library = Tokenizer.from_file(WORD_TOKENIZER)
    rows = ROWS + [(i, f"Row {i}, with <|endoftext|> and É. " * i) for i in range(20, 60)]
    docs = docs_of(rows)
    got = sorted(token_files.read_token_files(token_files.write_token_files(docs, WORD_TOKENIZER)).collect(), key=lambda r: r.start)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    at = 0
    assert len(got) == len(rows)
    for r, (doc, text) in zip(got, order):
        ids = library.encode(text or "", add_special_tokens=False).ids + [1]
        assert (r.doc_id, r.start, r.n_tokens, r.ids) == (doc, at, len(ids), ids)
        assert r.ids_crc32 == zlib.crc32(np.array(ids, dtype="<u4").tobytes())
        at += len(ids)
    assert token_files.read_token_files(token_files.write_token_files(docs.limit(0), WORD_TOKENIZER)).count() == 0


@pytest.mark.parametrize("values", [[0], [7] * 100, [1, 2, 3, 2**32 - 1], list(range(70_000, 78_192)), [5] * 95 + [60_000] * 5])
def test_blocks(values):
    ids = np.array(values, dtype=np.uint32)
    assert token_files.unpack_block(memoryview(token_files.pack_block(ids))).tolist() == values


def test_outliers_are_exceptions():
    ids = np.array([5, 6, 7, 8] * 250 + [60_000], dtype=np.uint32)
    assert len(token_files.pack_block(ids)) < 12 + 252 + 4 + 4 + 4


def test_top_k(spark):
    rng = np.random.default_rng(8)
    rows = [(int(i), [float(np.float32(v)) for v in rng.normal(0, 0.2, 6)], "a") for i in range(180)]
    rows += [(200 + i, rows[0][1], "tie") for i in range(20)]  # ties everywhere
    bad = [(300, None, ""), (301, [0.1, None, 0.2, 0.1, 0.1, 0.1], ""), (350, [float("nan")] * 6, ""), (None, [0.5] * 6, ""), (400, [0.5, 0.5], ""), (401, [0.25, 1.0], "")]
    got = topk_search.top_k(spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>, rank string")).collect()
    fine = [(i, np.floor(256 * np.array(v)).astype(int)) for i, v, _ in rows + bad[-2:]]
    expected = []
    for q, vector in fine:
        if q % 50 == 0:
            scored = sorted((-int(vector @ v), i) for i, v in fine if i != q and len(v) == len(vector))[:5]
            expected += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored)]
    assert sorted(map(tuple, got)) == sorted(expected)
    assert topk_search.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_chats(spark):
    odd = "<|im_end|>\n <|im_start|>user<|im_sep|> [INST] [\\INST] <\\|x <s></s> [\\\\/INST] \\"
    rows = [(1, 0, "user", odd), (1, 1, "assistant", odd), (1, 2, "assistant", None), (1, 3, "user", ""), (1, 4, "assistant", "b"), (2, 0, None, "x"), (2, None, "<|im_sep|>", "y"), (3, 0, "assistant", ""), (3, 0, "assistant", ""), (None, 0, "user", "z")]
    chats = chat_format.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {r.conv_id: r for r in chat_format.read_chats(chats).collect()}
    turns = lambda i: [tuple(t) for t in got[i].turns]
    assert turns(1) == [("user", odd), ("assistant", odd), ("assistant", ""), ("user", ""), ("assistant", "b")]
    assert got[1].loss_text == odd + "b" and got[1].formatted.count("<|im_start|>") == 4
    assert turns(2) == [("<|im_sep|>", "y"), ("", "x")] and turns(3) == [("assistant", "")] * 2 and turns(None) == [("user", "z")]


def test_mixing(docs_of):
    docs = docs_of([*ROWS[:8], (7, "word " * 30), *ROWS[9:], *((i, "t" * (i % 7)) for i in range(1000, 3000))])
    got = mixing.mix_sources(docs, {"src0": 3.0, "absent": 9.0}, other=1.0, factor=2.0).collect()
    size = lambda rows: sum(len(r.text or "") + 1 for r in rows)
    total = size(docs.collect())
    assert abs(size([r for r in got if r.source == "src0"]) / total - 1.5) < 0.1
    assert abs(size([r for r in got if r.source is None]) / total - 0.5) < 0.1
    again = mixing.mix_sources(docs.repartition(7), {"src0": 3.0, "absent": 9.0}, other=1.0, factor=2.0).collect()
    assert sorted((str(r.doc_id), r.copy, r.shuffle_key) for r in got) == sorted((str(r.doc_id), r.copy, r.shuffle_key) for r in again)
    assert mixing.mix_sources(docs.limit(0), {"src0": 1.0}).count() == 0
    assert {r.source for r in mixing.mix_sources(docs, {"src0": 1.0}).collect()} == {"src0"}


def test_mixing_of_a_long_text(docs_of):
    rows = [*ROWS, *((i, "t" * (i % 7)) for i in range(1000, 1400))]
    texts = {r[1] for r in rows}
    got = mixing.mix_sources(docs_of(rows), {"src0": 3.0}, other=1.0, factor=20.0).collect()
    assert {r.text for r in got} <= texts and sum(r.doc_id == 7 for r in got) > 0


@pytest.mark.parametrize("seed", ["mix-1", "mix-2", "mix-3"])
def test_mixing_draws_rows_without_ids_one_by_one(spark, seed):
    """Null ids, one id for many rows, equal rows and rows with texts of their own: as many as asked for, all over the partitions."""
    n = 4000
    rows = spark.range(4 * n).selectExpr(
        f"case when id < 2 * {n} then null when id < 3 * {n} then 5 else id end as doc_id", f"case when id < {n} then 'same' else concat('t', id) end as text", "'x' as lang", "null as source", "1 as n_chars"
    )
    got = mixing.mix_sources(rows, {}, other=1.0, seed=seed).withColumn("part", F.spark_partition_id())
    kinds = got.groupBy(F.expr("case when doc_id is null and text = 'same' then 0 when doc_id is null then 1 when doc_id = 5 then 2 else 3 end").alias("kind"))
    counts = {r.kind: (r.n, r.parts) for r in kinds.agg(F.count("*").alias("n"), F.countDistinct("part").alias("parts")).collect()}
    parts = got.select("part").distinct().count()
    total = sum(c for c, _ in counts.values())
    assert len(counts) == 4 and all(p == parts for _, p in counts.values()) and abs(total - 4 * n) < 5 * (4 * n) ** 0.5
    assert got.select("shuffle_key").distinct().count() == total


def test_mixing_twin_with_shared_ids(spark):
    rows = [(None if i % 3 == 0 else i // 4, None if i % 7 == 0 else f"text {i % 11}", "l", f"src{i % 6}" if i % 5 else None, i % 2) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    duck = duckdb.connect()
    duck.register("documents", df.toArrow())
    cursor = duck.execute(queries.OP4)
    names = [d[0] for d in cursor.description]
    got = mixing.mix_sources(df, queries.TARGETS, queries.OTHER, seed=queries.MIX_SEED)
    assert rows_of(got.columns, [tuple(r) for r in got.collect()]) == rows_of(names, cursor.fetchall())


@pytest.mark.parametrize("mean", [0.3, 1.0, 16.0, 40.5])
def test_poisson(spark, mean):
    row = spark.range(20_000).select(mixing.poisson_count(F.col("id").cast("string"), mean, "t").alias("n")).agg(F.avg("n"), F.var_samp("n")).first()
    assert abs(row[0] - mean) < 5 * (mean / 20_000) ** 0.5 and abs(row[1] / mean - 1) < 0.08


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_twins(spark, name):
    duck = duckdb.connect()
    for table in ("documents", "conversations", "embeddings"):
        duck.execute(f"create view {table} as select * from '{SF}/{table}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    cursor = duck.execute(queries.ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(df.columns)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(names, cursor.fetchall())


def test_pipeline_stages(spark, docs_of):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = spark.createDataFrame([(i and i + 10**6, t, None, None, None) for i, t in ROWS], docs.schema)
    docs = docs.unionByName(extra).cache()
    at, texts = docs, {}
    for name, stage in corpus_pipeline.STAGES[:4]:
        before, at = at, stage(spark, at, SF).cache()
        assert at.columns == docs.columns, name
        texts[name] = (before.collect(), at.collect())
    before, after = texts["quality rules"]
    judged = [(r.doc_id, quality_rules.judge(r.text, quality_rules.LineRules())) for r in before]
    assert sorted((str(i), j[-1]) for i, j in judged if j[6]) == sorted((str(r.doc_id), r.text) for r in after)
    before, after = texts["near-duplicates"]
    assert len(after) == len(set(alike([r.text for r in before]))) and {r.text for r in after} <= {r.text for r in before}
    last = corpus_pipeline.tokens_stage(spark, at, SF).collect()
    assert len(last) == at.count() and all(r.exact for r in last)
    empty = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0, name


def jaccard(a, b, size=5):
    sets = [{tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} for w in (a.lower().split(), b.lower().split())]
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def alike(texts):
    """Component of each text by all pairs of 5-word shingle sets with a Jaccard similarity of 0.8 or more."""
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for w in (t.encode().lower().split() for t in texts)]
    names = list(range(len(texts)))
    for i, x in enumerate(sets):
        for j in range(i):
            if names[i] != names[j] and len(x & sets[j]) >= 0.8 * len(x | sets[j]):
                names = [names[j] if n == names[i] else n for n in names]
    return names


def test_near_copies_by_jaccard(spark):
    """Copies of 0.8 to 0.95 leave, texts below 0.8 stay; a chain is one group."""
    rng = random.Random(9)
    docs, group = [], 0
    for i in range(60):
        words = [f"w{rng.randint(0, 9999)}" for _ in range(200)]
        for _ in range(3):
            docs.append((len(docs), " ".join(words)))
            for _ in range(rng.randint(1, 6)):
                words[rng.randrange(200)] = f"new{rng.randint(0, 9999)}"
    names = list(range(len(docs)))
    for i, (_, x) in enumerate(docs):
        for j in range(i):
            if i // 3 == j // 3 and jaccard(x, docs[j][1]) >= 0.8:
                names = [names[j] if n == names[i] else n for n in names]
    table = spark.createDataFrame([(i, t, None, None, None) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id for r in corpus_pipeline.dedup_stage(spark, table, SF).collect()}
    expected = {min(i for i, m in enumerate(names) if m == n) for n in names}
    assert len(expected) < 140 and got == expected
    assert corpus_pipeline.dedup_stage(spark, table.limit(0), SF).count() == 0


def test_near_copies_of_documents(spark):
    """The stage after the two before it, against all pairs."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = corpus_pipeline.rules_stage(spark, corpus_pipeline.classifier_stage(spark, docs, SF), SF).cache()
    texts = sorted((r.doc_id, r.text) for r in before.collect())
    names = alike([t for _, t in texts])
    expected = {min(d for (d, _), m in zip(texts, names) if m == n) for n in set(names)}
    assert {r.doc_id for r in corpus_pipeline.dedup_stage(spark, before, SF).collect()} == expected


def test_near_copies_without_a_common_first(spark, monkeypatch):
    """Members of one bucket that are unlike its first are compared with one another."""
    monkeypatch.setattr(near_copies, "keys_of", lambda least: (np.arange(len(least)), np.zeros(len(least), dtype=np.int64)))
    texts = [" ".join(f"{c}{i}" for i in range(100)) + end for c in "abcdef" for end in ("", " x", " x y")]
    rows = spark.createDataFrame(list(enumerate(texts)), "row long, text string")
    groups = {}
    for r in near_copies.near_copies(rows).collect():
        groups.setdefault(r.component, set()).add(r.row)
    assert sorted(map(sorted, groups.values())) == [[3 * i, 3 * i + 1, 3 * i + 2] for i in range(6)]


def test_members_travel_only_with_a_stranger(spark):
    """Of the buckets that hold two components, only members that may be alike with one of another component go on."""
    rng = np.random.default_rng(4)
    hot, far = rng.integers(-(1 << 62), 1 << 62, (2, 2))
    size = 40
    members = [(1, i, 0, size, *hot) for i in range(300)] + [(1, 300, 300, size, *far), (1, 301, 301, size // 2, *hot)]  # unlike in bits, or in size
    members += [(2, i, 0, size, *hot) for i in range(300)] + [(2, 302, 302, size, hot[0] ^ 1, hot[1])]  # one more component, and alike
    members += [(3, i, i, size, *rng.integers(-(1 << 62), 1 << 62, 2)) for i in range(400, 420)] + [(4, i, 7, size, *hot) for i in range(5)]
    rows = spark.createDataFrame([tuple(map(int, m)) for m in members], "key long, sig long, component long, n long, bits_0 long, bits_1 long")
    got = sorted(tuple(r) for r in near_copies._mixed(rows.repartition(7), 0.8).collect())
    assert got == [(2, i, 0) for i in range(300)] + [(2, 302, 302)]


def test_simhash_copies_leave_too(spark):
    """A text that says one line fifty times and little else: equal in SimHash, far apart as a set; its copy by set goes with it."""
    line = " ".join(f"w{i}" for i in range(21))
    tail = lambda c, n: " ".join(f"{c}{i}" for i in range(n))
    texts = {2: f"{line} " * 50 + tail("a", 60), 1: f"{line} " * 50 + tail("b", 60), 4: f"{line} " * 50 + tail("a", 58), 3: tail("c", 200)}
    bits = simhash_golay.differing(*(np.array([simhash_golay.fingerprint(texts[i])], dtype=np.uint64) for i in (1, 2)))
    assert bits <= 4 and jaccard(texts[1], texts[2]) < 0.3 and jaccard(texts[2], texts[4]) >= 0.8
    table = spark.createDataFrame([(i, t, None, None, None) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in corpus_pipeline.dedup_stage(spark, table, SF).collect()) == [1, 3]


def test_clashing_ids_lose_no_text(spark):
    """Text b under id 2 is in the group of id 1; the other text of id 2 stays, as does that of a clashing unique id."""
    text = lambda c: " ".join(f"{c}{i}" for i in range(60))
    rows = [(1, text("b")), (2, text("b")), (2, text("z")), (3, text("x")), (3, text("y")), (3, text("y")), (None, text("n")), (None, text("y"))]
    table = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(((r.doc_id or 0, r.text[0]) for r in corpus_pipeline.dedup_stage(spark, table, SF).collect()))
    assert got == [(0, "n"), (1, "b"), (2, "z"), (3, "x"), (3, "y")]


def test_links_within_a_bucket():
    """Components after the links of a bucket equal those of all pairs, and no link is spare."""
    rng = random.Random(8)
    base = [rng.sample(range(10_000), 40) for _ in range(4)]
    sets = [np.unique(rng.sample(b, rng.randint(34, 40)) + rng.sample(range(10_000), rng.randint(0, 4))) for b in base for _ in range(25)] + [np.array([5])] * 2
    names = np.array([i // 2 for i in range(len(sets))])
    signs = np.array(rng.sample(range(-500, 500), len(sets)))
    found = near_copies._joins(signs, names.copy(), np.array([len(s) for s in sets]), np.concatenate(sets), 0.8)

    def groups(pairs):
        parent = {int(s): int(signs[i - i % 2]) for i, s in enumerate(signs)}
        for a, b in pairs:
            x, y = parent[a], parent[b]
            parent = {k: y if v == x else v for k, v in parent.items()}
        return {frozenset(k for k in parent if parent[k] == v) for v in parent.values()}

    alike = lambda x, y: len(np.intersect1d(x, y)) >= 0.8 * len(np.union1d(x, y))
    plain = [(int(signs[i]), int(signs[j])) for i in range(len(sets)) for j in range(i) if alike(sets[i], sets[j])]
    assert groups(found) == groups(plain) and len(found) == len(set(names.tolist())) - len(groups(plain)) and all(a > b for a, b in found)
