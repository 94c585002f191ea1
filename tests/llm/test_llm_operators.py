"""Corpus operators against plain versions, with nulls, blanks, ties, repeats, long texts and empty tables."""

import gzip
import math
import os
import random

import numpy as np
import public_tokenizers
import pytest
from brute import KneserNey, bench_words, contamination, cut, digest, near, statistics, words
from pyspark.sql import functions as F

from cohortloom.llm import (
    decontaminate, language_id, license_scan, mixing, near_dedup, ngram_lm, quality_rules, queries, suffix_dedup, token_counts, warc,
)
from cohortloom.llm.common import bucket_of, word_bytes

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
VOCAB = [a + b for a in ("th", "er", "on", "ñe", "ü", "st", "re") for b in ("the", "an", "ion", "ó", "ed", "ß", "ly")] + ["the", "of", "and"]


def prose(rng, n):
    out = []
    for i in range(n):
        w = rng.choice(VOCAB)
        out.append(w.capitalize() if rng.random() < 0.1 else w)
        out.append(rng.choice([" ", " ", " ", " ", "  ", "\t", "\n", ". "]))
    return "".join(out)


def corpus(seed=1, n=60):
    """Prose with exact and near copies, shared passages, and every odd text."""
    rng = random.Random(seed)
    texts = [prose(rng, rng.randint(15, 160)) for _ in range(n)]
    passage = prose(rng, 60)
    for i in range(0, n, 7):
        texts[i] += passage
    for i in range(0, n, 6):
        w = texts[i].split(" ")
        w[len(w) // 2] = "edited"
        texts.append(" ".join(w))
    texts += [texts[3], texts[3], texts[4]]
    texts += [None, "", " \t\n", "one", "One", "two words", "two  WORDS", "a" * 900, "a" * 700, "ñ" * 400, "<|endoftext|> x", "!!! ... ---"]
    texts.append(prose(rng, 12_000))
    return texts


def frame(spark, texts, parts=3, **more):
    rows = [(i, t, more.get("lang", "en"), f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS).repartition(parts)


@pytest.fixture(scope="module")
def texts():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, texts):
    return frame(spark, texts).withColumns({"n": F.lit(1), "text_key": F.lit("x"), "id": F.lit(2), "score": F.lit("s")}).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


# ---- near-duplicates -----------------------------------------------------------------------------


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates_equal_all_pairs(docs, texts, k):
    want = near(dict(enumerate(texts)), k)
    got = {r.doc_id: r for r in near_dedup.near_duplicates(docs, near_dedup.Plan(words=k)).collect()}
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.values())


def test_near_duplicates_of_a_chain_and_a_star(spark):
    """Neighbours in a chain are linked, its ends are not; edits of one text hang together by it."""
    rng = random.Random(5)
    base = [f"w{i}" for i in range(60)]
    rows, now = [], list(base)
    for _ in range(25):
        rows.append(" ".join(now))
        now[rng.randrange(60)] = f"x{rng.random()}"
    star = [f"y{i}" for i in range(80)]
    for k in range(40):
        own = list(star)
        for j in rng.sample(range(80), 3):
            own[j] = f"z{k}-{j}"
        rows.append(" ".join(own))
    want = near(dict(enumerate(rows)), 2)
    got = near_dedup.near_duplicates(frame(spark, rows), near_dedup.Plan(words=2)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want


@pytest.mark.parametrize("tile", [3, 10])
def test_near_duplicates_in_tiles(spark, monkeypatch, tile):
    """Keys with more classes than a tile: same components, with and without classes that lie in all tiles."""
    rng = random.Random(31)
    rows = []
    for g in range(3):
        base = [f"g{g}w{i}" for i in range(70)]
        for k in range(25):
            own = list(base)
            for j in rng.sample(range(70), rng.choice([1, 2, 6, 9])):
                own[j] = f"e{g}-{k}-{j}"
            rows.append(" ".join(own))
    want = near(dict(enumerate(rows)), 2)
    for common in (0, 4):
        monkeypatch.setattr(near_dedup, "COMMON", common)
        got = near_dedup.near_duplicates(frame(spark, rows), near_dedup.Plan(words=2), tile=tile).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want


def test_near_pairs_of_different_tiles_without_another_near_class(spark, monkeypatch):
    """Two classes near each other only, among unrelated ones of the same large keys (one bit a minimum)."""
    monkeypatch.setattr(near_dedup, "COMMON", 0)
    rows = [" ".join(f"t{t}w{i}" for i in range(60)) for t in range(100)]
    rows += [t.rsplit(" ", 1)[0] + " edited" for t in rows[:15]]
    want = near(dict(enumerate(rows)), 2)
    got = near_dedup.near_duplicates(frame(spark, rows), near_dedup.Plan(similarity=90, words=2, bits=1), tile=2).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert sum(r.kept for r in got) == 100


def test_every_pair_within_the_distance_shares_a_key(spark):
    plan = near_dedup.Plan()
    assert plan.errors >= 1 and plan.distance < (plan.errors + 1) * plan.chunks
    rng = random.Random(2)
    a = [rng.randrange(1 << 16) for _ in range(plan.hashes)]
    rows = [(0, a)]
    for k in range(1, 30):
        b = list(a)
        for j in rng.sample(range(plan.hashes), plan.distance):
            b[j] ^= 1 + rng.randrange(60_000)
        rows.append((k, b))
    keys = spark.createDataFrame(rows, "id int, sig array<int>").select("id", plan.keys(F.col("sig")).alias("k")).collect()
    first = set(keys[0].k)
    assert all(first & set(r.k) for r in keys)


def test_near_duplicates_repeated_rows_null_ids_and_nothing(spark, empty):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(5, text, None, None, 1), (5, text, None, None, 1), (None, text, None, None, 1), (None, "alone here", None, None, 1),
            (9, None, None, None, 1), (9, None, None, None, 1)]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, DOCS)).select("doc_id", "component_id", "kept").collect()
    assert sorted(map(tuple, got), key=str) == sorted(
        [(5, 5, True), (5, 5, True), (None, 5, False), (None, None, True), (9, 9, True), (9, 9, True)], key=str)
    assert near_dedup.near_duplicates(empty).count() == 0


def test_near_duplicates_do_not_broadcast_their_keys(docs, monkeypatch):
    """Spark takes the exploded keys of classes for one value a class, so their file looks small enough to broadcast."""
    plans = {}

    def kept(df, path, stage=near_dedup.stage):
        plans[path.rsplit("/", 1)[-1]] = df._jdf.queryExecution().executedPlan().toString()
        return stage(df, path)

    monkeypatch.setattr(near_dedup, "stage", kept)
    near_dedup.near_duplicates(docs, near_dedup.Plan(words=2))
    for name in ("met", "stars-1"):
        assert "SortMergeJoin" in plans[name] and "BroadcastHashJoin" not in plans[name]


def test_components_of_a_long_path(spark, tmp_path):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001), (7, 7)], "a bigint, b bigint")
    got = {r.node: r.root for r in near_dedup.components(edges, str(tmp_path / "c")).collect()}
    assert got == {**{i: 0 for i in range(1, 301)}, 1001: 1000}


# ---- repeated bytes ------------------------------------------------------------------------------


@pytest.mark.parametrize("spread", [20_000, 0])
@pytest.mark.parametrize("length,gram", [(200, 32), (40, 32), (25, 32), (60, 7)])
def test_repeated_bytes_equal_brute_force(docs, texts, length, gram, spread):
    want = cut(texts, length)
    got = suffix_dedup.remove_repeats(docs, ["doc_id"], length, digest=True, gram=gram, spread=spread).collect()
    for r in got:
        n, gone, spans, rest = want[r.doc_id]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (n, gone, spans, digest(rest)), r.doc_id


def test_repeats_over_the_cuts_of_a_long_text(spark, monkeypatch):
    rng = random.Random(3)
    text = "".join(rng.choice("abcdefgh ñ") for _ in range(9000))
    rows = [text, "x" + text[4000:4500] + "y", text[100:260]]
    monkeypatch.setattr(suffix_dedup, "PIECE", 1 << 10)
    blocks = suffix_dedup.blocks_of([t.encode() for t in rows], 100)
    assert blocks[3].sum() == sum(max(0, len(t.encode()) - 99) for t in rows)  # every window once
    got = suffix_dedup.remove_repeats(frame(spark, rows), ["doc_id"], 100, digest=True).collect()
    want = cut(rows, 100)
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == {
        i: (*w[:3], digest(w[3])) for i, w in enumerate(want)}


def test_cut_text_has_no_half_characters(spark):
    rows = ["é" + "ab" * 150 + "ü", "xé" + "ab" * 150 + "ö", None]
    got = {r.doc_id: r.kept_text for r in suffix_dedup.remove_repeats(frame(spark, rows), ["doc_id"], 201).collect()}
    assert got[2] is None and got[0] == "" and got[1] == "x"


def test_repeats_of_repeated_rows_and_nothing(spark, empty):
    text = "".join(random.Random(4).choice("abcdef") for _ in range(300))
    rows = spark.createDataFrame([(1, text, None, None, 1), (1, text, None, None, 1), (None, text[:250], None, None, 1)], DOCS)
    got = suffix_dedup.remove_repeats(rows, ["doc_id"], digest=True).collect()
    assert [r.n_bytes - r.n_removed for r in got] == [0, 0, 0]
    assert suffix_dedup.remove_repeats(empty, ["doc_id"], digest=True).count() == 0


# ---- benchmark -----------------------------------------------------------------------------------


def test_contamination_equals_brute_force(spark, docs, texts):
    items = [(1, " ".join(bench_words(texts[2])[5:30])), (2, "one"), (3, None), (4, " , "), (10, "Two, words!"), (2, texts[9]),
             (7, texts[-1][200:400]), (8, "ñ" * 400), (None, "not in any text")]
    frame_ = spark.createDataFrame(items, "item_id bigint, text string")
    want = contamination(texts, [("" if i is None else i, t) for i, t in items])
    for limit in (2_000_000, 30):  # one block, and one per few words
        got = decontaminate.contamination(docs, frame_, keep=["doc_id"], block_words=limit).collect()
        assert {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in got} == dict(enumerate(want))
        assert all(r.n_items == len(r["items"]) for r in got)


def test_contamination_of_nothing(spark, docs, empty):
    items = spark.createDataFrame([(1, "a b c")], "item_id bigint, text string")
    assert decontaminate.contamination(empty, items).count() == 0
    assert decontaminate.contamination(docs, items.limit(0)).where("n_hit > 0 or n_items > 0").count() == 0
    kept = decontaminate.contamination(docs, items)
    assert set(docs.columns) <= set(kept.columns) and kept.count() == docs.count()


# ---- token counts --------------------------------------------------------------------------------


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_token_counts_equal_whole_encoding(docs, texts, tmp_path, name):
    path = public_tokenizers.path(name)
    odd = ["a\x1cb \x85 c　d", "it's  \n\n we'll   ", "x<|endoftext|>y <|endoftext|>", "日本 語 ١٢٣ é", "\r\n\r\n a", "    x"]
    more = frame(docs.sparkSession, [*texts, *odd])
    got = {r.doc_id: r for r in token_counts.count_tokens(more, path, str(tmp_path / "cache")).collect()}
    if name.endswith(".json"):
        from tokenizers import Tokenizer

        encode = Tokenizer.from_file(path)
        want = [len(encode.encode(t or "", add_special_tokens=False)) for t in [*texts, *odd]]
    else:
        import sentencepiece

        want = [len(sentencepiece.SentencePieceProcessor(model_file=path).encode(t or "")) for t in [*texts, *odd]]
    assert [got[i].n_tokens for i in range(len(want))] == want
    assert all(r.over_limit == (r.n_tokens > 512) for r in got.values())
    assert got[0].n_bytes == len(texts[0].encode())


def test_cache_encodes_only_misses(spark, texts, tmp_path, empty):
    path, cache = public_tokenizers.path("byte_bpe_50k.json"), str(tmp_path / "cache")
    first = token_counts.count_tokens(frame(spark, texts[:20]), path, cache).collect()
    held = spark.read.parquet(cache).count()
    assert held == len(set(texts[:20]))
    assert sorted(token_counts.count_tokens(frame(spark, texts[:20]), path, cache).collect()) == sorted(first)
    assert spark.read.parquet(cache).count() == held
    token_counts.count_tokens(frame(spark, texts[:25]), path, cache).collect()
    assert spark.read.parquet(cache).count() == len(set(texts[:25]))
    # A count that the cache holds is used as it is, one of another tokenizer is not.
    spark.read.parquet(cache).withColumn("n_tokens", F.lit(7).cast("bigint")).write.parquet(cache + "-b")
    assert {r.n_tokens for r in token_counts.count_tokens(frame(spark, texts[:20]), path, cache + "-b").collect()} == {7}
    other = public_tokenizers.path("word_bpe_49k.json")
    assert {r.n_tokens for r in token_counts.count_tokens(frame(spark, texts[:20]), other, cache + "-b").collect()} != {7}
    assert token_counts.count_tokens(empty, path, cache + "-c").count() == 0


def test_the_query_counts_against_a_cache_that_holds_a_part(docs, texts, spark, tmp_path, monkeypatch):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    held, cache = [], str(tmp_path / "cache")

    def exists(session, path, real=token_counts.path_exists):
        found = real(session, path)
        held.append(session.read.parquet(path).count() if found else 0)
        return found

    monkeypatch.setattr(token_counts, "path_exists", exists)
    monkeypatch.setattr(queries, "scratch", lambda *_: cache)
    got = queries.op8_token_counts(spark, str(tmp_path)).collect()
    n = len({t or "" for t in texts})
    assert held[0] == 0 and 0 < held[-1] < n
    assert spark.read.parquet(cache).count() == n
    whole = token_counts.count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), str(tmp_path / "whole")).drop("content_digest")
    assert sorted(got) == sorted(whole.collect())


# ---- archives ------------------------------------------------------------------------------------

PAGES = "page_id bigint, url string, html string"


def pages(spark):
    rng = random.Random(8)
    big = "<p>" + prose(rng, 80)
    rows = [(k, f"http://a.example/{k}?q=ü x", f"<html>{prose(rng, rng.randint(1, 300))}") for k in range(40)]
    rows += [(k, "http://b.example/", big) for k in (99, 77, 88, 77)] + [(k, None, "short") for k in (200, 201)]
    rows += [(300, "u", None), (301, "u", ""), (None, "u", big), (302, "u", "a" * 99), (303, "u", "a" * 99), (304, "u", "é" * 50), (305, "u", "é" * 50)]
    return spark.createDataFrame(rows, PAGES).repartition(3)


@pytest.mark.parametrize("ranges", [97, 5_000, 64 << 20])
def test_archives_round_trip(spark, tmp_path, ranges):
    table = pages(spark)
    manifest = warc.archive_pages(table, str(tmp_path / "w"), file_bytes=4_000)
    got = warc.read_archives(spark, manifest, range_bytes=ranges).collect()
    rows = table.collect()
    assert len(got) == len(rows) == manifest.agg(F.sum("n_records")).first()[0]
    first = {}
    for r in rows:
        body = (r.html or "").encode()
        if len(body) >= 100 and r.page_id is not None:
            first[body] = min(first.get(body, r.page_id), r.page_id)
    want = []
    for r in rows:
        body = (r.html or "").encode()
        again = r.page_id is not None and body in first and r.page_id > first[body]
        key = None if r.page_id is None else str(r.page_id)
        want.append((key, r.url, "revisit" if again else "response", str(first[body]) if again else None, len(body), digest(body),
                     None if again else body))
    found = [(r.key, r.url, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest, None if r.payload is None else bytes(r.payload))
             for r in got]
    assert sorted(map(str, found)) == sorted(map(str, want))


def test_reader_skips_false_members(spark, tmp_path):
    """Magic bytes in junk, and gzip members that are no records, are not records."""
    good = warc.record_bytes("k", "http://x/", b"body", digest(b"body"), "response", None, 0)
    junk = warc.MAGIC + b"\x00" * 20 + gzip.compress(b"not a record") + warc.MAGIC
    data = good + junk + good + warc.MAGIC[:2]
    (tmp_path / "x.gz").write_bytes(data)
    files = spark.createDataFrame([(str(tmp_path / "x.gz"), len(data)), (str(tmp_path / "none"), 0)], "path string, n_bytes bigint")
    for size in (50, 1000):
        got = warc.read_archives(spark, files, range_bytes=size).collect()
        assert sorted(r.place for r in got) == [0, len(good) + len(junk)]
    assert warc.read_archives(spark, files.limit(0)).count() == 0


def test_a_changed_payload_is_an_error(spark, tmp_path):
    bad = warc.record_bytes("k", None, b"body", digest(b"other"), "response", None, 0)
    (tmp_path / "x.gz").write_bytes(bad)
    files = spark.createDataFrame([(str(tmp_path / "x.gz"), len(bad))], "path string, n_bytes bigint")
    with pytest.raises(Exception, match="digest"):
        warc.read_archives(spark, files).collect()


def test_headers_of_any_length_and_the_count_of_records(spark, tmp_path):
    rng = random.Random(8)
    urls = ["http://x/" + "".join(rng.choices("abcdefghijklmnop0123456789", k=100_000)), "http://x/" + "ñ" * 40_000, "http://x/"]
    table = spark.createDataFrame([(k, u, f"body {k}") for k, u in enumerate(urls)], "page_id bigint, url string, html string")
    manifest = warc.archive_pages(table, str(tmp_path / "w"))
    for size in (3_000, 1 << 20):
        records = warc.read_archives(spark, manifest, range_bytes=size)
        got = warc.verified(records, manifest, str(tmp_path / f"records-{size}")).collect()
        assert sorted((int(r.key), r.url) for r in got) == list(enumerate(urls))
    with pytest.raises(ValueError, match="manifest"):
        warc.verified(records.where("key <> '1'"), manifest, str(tmp_path / "fewer"))
    with pytest.raises(ValueError, match="manifest"):
        warc.verified(records.limit(0), manifest, str(tmp_path / "none"))


def test_archives_of_no_pages(spark, tmp_path):
    manifest = warc.archive_pages(spark.createDataFrame([], PAGES), str(tmp_path / "w"))
    assert warc.read_archives(spark, manifest).count() == 0


# ---- language model ------------------------------------------------------------------------------


@pytest.mark.parametrize("order,shard_bytes", [(1, 1 << 20), (2, 3_000), (3, 5_000), (4, 1 << 20)])
def test_language_model_equals_plain_kneser_ney(spark, docs, texts, tmp_path, order, shard_bytes):
    held = bucket_of(F.col("doc_id"), 7) == 2
    out = {r.doc_id: r.h for r in docs.select("doc_id", held.alias("h")).collect()}
    model = ngram_lm.fit(docs.where(~held), str(tmp_path / "lm"), order, shard_bytes=shard_bytes)
    want = KneserNey([words(t) for i, t in enumerate(texts) if not out[i]], order)
    n, v = sum(want.unigrams.values()), len(want.unigrams)
    for r in ngram_lm.score(docs, model, ["doc_id"]).collect():
        tokens = [*words(texts[r.doc_id]), "</s>"]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(tokens), sum(t in want.unigrams for t in tokens), n)
        assert r.base_score == pytest.approx(sum(math.log10((want.unigrams[t] + 1) / (n + v + 1)) for t in tokens))
        assert r.score == pytest.approx(want.score(tokens[:-1]), rel=1e-9)
        assert r.perplexity == pytest.approx(10 ** (-r.score / r.n_tokens))


def test_probabilities_sum_to_one():
    """Over all words and one unknown word, for any context: a property of the formula that both versions use."""
    want = KneserNey([words(t) for t in corpus(2, 20) if t], 3)
    for context in (("<s>", "<s>"), ("the", "of"), ("never", "seen"), ("of", "never")):
        assert sum(want.p((*context, w)) for w in [*want.unigrams, "unknown word"]) == pytest.approx(1)


def test_language_model_has_one_file_a_shard_and_level(docs, texts, tmp_path):
    """A worker has all shards mapped; open files and mappings of a process are limited."""
    model = ngram_lm.fit(docs, str(tmp_path / "lm"), shard_bytes=2_000)
    shards = model.vocabulary.arrays.shards
    assert shards > 5 and len(list((tmp_path / "lm" / "arrays").iterdir())) <= 4 * shards
    before = len(os.listdir("/proc/self/fd"))
    ids = model.vocabulary.ids(np.array([ngram_lm.word_hash(w) for w in {w for t in texts for w in word_bytes(t)}], np.uint64))
    model.probabilities(np.stack([ids, np.roll(ids, 1), np.roll(ids, 2)], axis=1))
    assert len(os.listdir("/proc/self/fd")) - before <= 4 * shards


def test_language_model_of_nothing(spark, empty, docs, tmp_path):
    model = ngram_lm.fit(empty, str(tmp_path / "lm"))
    rows = ngram_lm.score(docs, model, ["doc_id"]).collect()
    assert all(r.n_known == 0 and r.base_score == 0 and r.score == 0 for r in rows)
    assert ngram_lm.score(empty, model, ["doc_id"]).count() == 0


# ---- quality rules -------------------------------------------------------------------------------


def test_statistics_equal_plain_ones(docs, texts, spark):
    line = "again and again the same words in this long line of ten"
    more = [*texts, "\n".join([line] * 5), line + " other " + line, " ".join(["x"] * 50), " ".join(["x"] * 8), " ".join(["x"] * 9),
            "a b c d e f g h i a b c d e f g h", "\n\n a \n b\n a \r\n", "é# *\x0b$%\x1c&|<>", "\x85 \xa0 x"]
    got = quality_rules.judge(frame(spark, more), [])
    for r in got.collect():
        want = statistics(more[r.doc_id])
        assert (r.s_n_words, r.s_word_chars, r.s_n_symbols, r.s_n_dup_lines, r.s_n_repeat_words, r.base_failed) == want, more[r.doc_id][:80]
        assert r.kept != r.base_failed


def labelled(spark, seed=3, n=400):
    rng = random.Random(seed)
    rows, marks = [], []
    for i in range(n):
        bad = i % 4 == 0
        text = prose(rng, rng.randint(30, 80))
        if bad:
            text = text.replace(" ", "## ") if i % 8 else text.upper().replace(" ", "!! ")
        rows.append((i, text, "en", "s", 0))
        marks.append((i, int(not bad), 0))
    return (spark.createDataFrame(rows, DOCS).repartition(3),
            spark.createDataFrame(marks + [(None, 0, 0), (3, None, 0), (10_000, 0, 0)], "doc_id bigint, quality int, toxic int"))


def test_rules_find_both_kinds_of_junk_and_keep_the_rest(spark):
    docs, labels = labelled(spark)
    rules = quality_rules.learn_rules(docs, labels)
    assert rules and all(1 <= len(r) <= 4 for r in rules)
    unseen, truth = labelled(spark, seed=11)
    got = quality_rules.judge(unseen, rules).where("not base_failed").join(truth, "doc_id").collect()
    assert sum(r.kept != (r.quality == 1) for r in got) <= 0.01 * len(got)
    # The verdict is the first rule that holds, condition by condition.
    for r in got:
        value = {f: (lambda a, b: r[a] / r[b] if b and r[b] else 0.0 if b else float(r[a]))(*quality_rules.FEATURES[f]) for f in quality_rules.FEATURES}
        hits = [k for k, rule in enumerate(rules, 1) if all((value[c.feature] > c.threshold) == c.above for c in rule)]
        assert r.rule == (hits[0] if hits else None) and r.kept == (not hits)


def test_growing_takes_the_condition_of_most_gain(spark):
    """One step against a plain search over all features, thresholds and directions."""
    rng = random.Random(6)
    data = [tuple([int(rng.random() < 0.3), True, *[round(rng.random(), 2) for _ in quality_rules.FEATURES]]) for _ in range(200)]
    names = list(quality_rules.FEATURES)
    rows = spark.createDataFrame(data, "bad int, grow boolean, " + ", ".join(f"{f} double" for f in names))
    cuts = {f: [0.1, 0.35, 0.5, 0.8] for f in names}
    rule = quality_rules._grow(rows, cuts, quality_rules.Settings(max_conditions=1))
    p0, n0 = sum(d[0] for d in data), sum(1 - d[0] for d in data)

    def gain(f, cut, above):
        hit = [d for d in data if (d[2 + names.index(f)] > cut) == above]
        p, n = sum(d[0] for d in hit), sum(1 - d[0] for d in hit)
        return quality_rules._gain(p, n, p0, n0)

    best = max(gain(f, c, a) for f in names for c in cuts[f] for a in (True, False))
    (c,) = rule
    assert gain(c.feature, c.threshold, c.above) == pytest.approx(best)


def test_rules_of_nothing(spark, empty, docs):
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert quality_rules.learn_rules(docs, none) == []
    assert quality_rules.learn_rules(empty, labelled(spark)[1]) == []
    assert quality_rules.judge(empty, []).count() == 0
    assert "python" not in quality_rules.judge(docs, [])._jdf.queryExecution().toString().lower()


# ---- mixing --------------------------------------------------------------------------------------


def test_mix_reaches_the_weights(spark):
    rows = [(i, "x" * 100, "en", "a" if i < 3000 else "b" if i < 3900 else None, 0) for i in range(4000)]
    table = spark.createDataFrame(rows, DOCS)
    got = mixing.mix(table, {"a": 0.2, "b": 0.3, None: 0.5}, total=400_000.0)
    share = {r.source: r.n for r in got.groupBy("source").agg(F.count("*").alias("n")).collect()}
    for source, want in {"a": 800, "b": 1200, None: 2000}.items():
        assert abs(share[source] - want) < 5 * math.sqrt(want)
    again = mixing.mix(table.repartition(7), {"a": 0.2, "b": 0.3, None: 0.5}, total=400_000.0)
    assert sorted(map(str, got.collect())) == sorted(map(str, again.collect()))
    assert set(got.select("source").distinct().toPandas()["source"]) == {"a", "b", None}
    assert {r.source for r in mixing.mix(table, {"a": 1.0}).collect()} == {"a"}


def test_poisson_is_inverted_exactly(spark):
    for mean in (0.0, 0.3, 2.5, 16.0):
        cdf = spark.range(1).select(mixing.poisson_cdf(F.lit(mean)).alias("c")).first().c
        exact, total = [], 0.0
        for k in range(len(cdf)):
            total += math.exp(-mean + (k * math.log(mean) if mean else (0 if k == 0 else -math.inf)) - math.lgamma(k + 1))
            exact.append(total)
        assert cdf[:-1] == pytest.approx(exact[:-1], abs=1e-12) and cdf[-1] == 1.0


def test_mix_takes_any_number_of_sources(spark):
    """A source per document, and one source with a third of them: every mean is met, nothing is gathered."""
    table = spark.range(9000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), 50).alias("text"), F.lit("en").alias("lang"),
                                     F.when(F.col("id") % 3 > 0, F.col("id").cast("string")).alias("source"), F.lit(50).cast("bigint").alias("n_chars"))
    n = {r.source is None: r.n for r in mixing.mix(table, exponent=1.0).groupBy("source").agg(F.count("*").alias("n")).groupBy(
        F.when(F.col("source").isNotNull(), "x").alias("source")).agg(F.sum("n").alias("n")).collect()}
    assert abs(n[True] - 3000) < 5 * math.sqrt(3000) and abs(n[False] - 6000) < 5 * math.sqrt(6000)
    n = mixing.mix(table, exponent=0.0).where("source is null").count()  # all sources equal: one of 6001
    assert n < 30


def test_mix_draws_are_inverted_hashes(spark):
    """Copies of every document against a plain inversion, with a source whose mean is drawn in parts."""
    import hashlib

    rows = [(i, "y" * (1 + i % 7), "en", ["a", "b", None][i % 50 and 1 + (i % 2)], 0) for i in range(400)] + [(None, "lost", "en", "a", 0)]
    table = spark.createDataFrame(rows, DOCS)
    weights = {"a": 0.8, "b": 0.15, None: 0.05}
    got = {(r.doc_id, r.text): r.n for r in mixing.mix(table, weights).groupBy("doc_id", "text").agg(F.count("*").alias("n")).collect()}
    size = {s: sum(len(r[1]) for r in rows if r[3] == s) for s in weights}
    deep = 0
    for i, text, _, source, _ in rows:
        mean = weights[source] * sum(size.values()) / size[source]
        parts = max(1, math.ceil(mean / 16))
        deep += parts > 1
        key = hashlib.md5(text.encode()).hexdigest() if i is None else str(i)
        want = 0
        for j in range(1, parts + 1):
            u = (int(hashlib.md5(f"mix:{key}:{j}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
            term = total = math.exp(-mean / parts)
            k = 0
            while total < u:
                k += 1
                term *= mean / parts / k
                total += term
            want += k
        assert got.get((i, text), 0) == want
    assert deep


def test_mix_shuffles_and_handles_nothing(spark, docs, empty):
    got = mixing.mix(docs, exponent=1.0).collect()
    keys = [r.shuffle_key for r in got]
    assert len(set(keys)) > 1 and set(docs.columns) <= set(got[0].asDict())
    assert mixing.mix(empty).count() == 0
    same = mixing.mix(docs.union(docs).where("doc_id = 5"), exponent=1.0).collect()
    assert len(same) % 2 == 0
    assert "python" not in mixing.mix(docs)._jdf.queryExecution().toString().lower()


# ---- language ------------------------------------------------------------------------------------


def tongues(spark, n=300):
    rng = random.Random(9)
    sounds = {"aa": ["ka", "to", "mi", "ra"], "bb": ["sch", "ung", "ei", "ber"], "cc": ["ñe", "ció", "lla", "que"]}
    rows = []
    for i in range(n):
        lang = rng.choice(list(sounds))
        text = " ".join("".join(rng.choice(sounds[lang]) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(4, 40)))
        rows.append((i, text, lang, "s", 0))
    return rows


def test_language_is_found_for_held_out_texts(spark):
    table = spark.createDataFrame(tongues(spark), DOCS).repartition(3)
    held = bucket_of(F.col("doc_id"), 5) == 0
    model = language_id.fit(table, ~held)
    got = language_id.identify(table.withColumn("held", held), model, ["doc_id", "held", "lang"]).collect()
    out = [r for r in got if r.held]
    assert len(out) > 20 and sum(r.lang == r.lang_pred for r in out) >= 0.97 * len(out)
    assert all(0 <= r.score <= 1 for r in got)
    # Neither the label nor the id is looked at in a prediction.
    blind = language_id.identify(table.withColumns({"lang": F.lit("zz"), "source": F.lit("q")}), model, ["doc_id"]).collect()
    assert {r.doc_id: r.lang_pred for r in blind} == {r.doc_id: r.lang_pred for r in got}


def test_language_of_odd_texts(spark, empty):
    table = spark.createDataFrame(tongues(spark, 60), DOCS)
    model = language_id.fit(table, F.lit(True))
    odd = frame(spark, [None, "", "123 !?", "ka", "ka" * 200_000])
    got = {r.doc_id: r for r in language_id.identify(odd, model, ["doc_id"]).collect()}
    assert [got[i].lang_pred for i in range(5)] == ["und", "und", "und", "aa", "aa"] and got[0].score == 0
    assert language_id.identify(empty, model, ["doc_id"]).count() == 0
    nothing = language_id.fit(empty, F.lit(True))
    assert {r.lang_pred for r in language_id.identify(odd, nothing, ["doc_id"]).collect()} == {"und"}
    one = language_id.fit(table.where("lang = 'aa'"), F.lit(True))
    assert {r.lang_pred for r in language_id.identify(table, one, ["doc_id"]).collect()} == {"aa"}
    unlabelled = language_id.fit(table.withColumn("lang", F.lit(None).cast("string")), F.lit(True))
    assert unlabelled.langs == []


# ---- licences ------------------------------------------------------------------------------------


def test_license_scan_equals_brute_force(spark):
    rng = random.Random(12)
    note = {k: t for k, t in license_scan.TEMPLATES[::-1]}
    rows = [
        ("a/LICENSE", note["MIT"]), ("a/x.txt", "plain words"), ("a/b/c/y.txt", prose(rng, 40)), ("a/b/LICENSE.md", "Intro\n" + note["Apache-2.0"]),
        ("a/b/c/z.txt", prose(rng, 30) + "\n" + note["GPL-3.0"]), ("q/x.txt", "the license of the work is free"), ("r.txt", None), (None, "x"),
        ("a/b/x.txt", ""), ("a/b/x.txt", ""), ("t/COPYING", "Licensed under CC BY-NC 4.0."), ("t/u/v/w.txt", "x"), ("t/LICENSE", "Licensed under CC BY 4.0."),
        ("s/LICENSE", "nothing of the kind"), ("s/x", "y"),
    ]
    table = spark.createDataFrame([(*r, 1) for r in rows], "path string, text string, license int")
    got = sorted(map(str, (tuple(r) for r in license_scan.scan(table).collect())))

    # plain: cosine of every segment with every template, without passing any over
    texts = [t or "" for _, t in rows]
    df = {w: sum(w in license_scan.words_of(t) for t in texts) for _, t in license_scan.TEMPLATES for w in license_scan.words_of(t)}
    idf = {w: math.log((1 + len(rows)) / (1 + n)) + 1 for w, n in df.items()}
    other = math.log(1 + len(rows)) + 1

    def vector(text):
        v = {}
        for w in license_scan.words_of(text):
            v[w] = v.get(w, 0) + idf.get(w, other)
        return v

    def cosine(a, b):
        size = math.sqrt(sum(x * x for x in a.values())) * math.sqrt(sum(x * x for x in b.values()))
        return sum(x * b.get(w, 0) for w, x in a.items()) / size if size else 0.0

    own = []
    for t in texts:
        best = {}
        for s in license_scan.segments(t):
            here, named_by = {}, {}
            for k, x in license_scan.TEMPLATES:
                words_here = license_scan.words_of(s)
                named = {w.lower() for i, w in enumerate(license_scan.WORD.findall(x)) if (i and w[0].isupper()) or any(c.isdigit() for c in w)}
                score = cosine(vector(s), vector(x))
                if named <= set(words_here) and score > here.get(k, 0.0):
                    here[k], named_by[k] = score, named
            fine = [named_by[k] for k, v in here.items() if v >= 0.7]
            here = {k: v for k, v in here.items() if v < 0.7 or not any(named_by[k] < n for n in fine)}
            order = sorted(here.values(), reverse=True)
            for k, v in here.items():
                if v == order[0] and v >= 0.7 and (len(order) == 1 or v - order[1] >= 0.02):
                    best[k] = max(best.get(k, 0.0), v)
        top = max(best.items(), key=lambda x: x[1], default=(None, 0.0))
        own.append((top[0], top[1]) if best else (None, None))
    dirs = {}
    for (path, _), (lic, score) in zip(rows, own):
        name = (path or "").rpartition("/")
        if lic and license_scan.re.search(license_scan.LICENSE_FILE, path or ""):
            dirs.setdefault(name[0], []).append((-score, lic))
    want = []
    for (path, _), (lic, score) in zip(rows, own):
        at, found = (path or "").rpartition("/")[0], None
        while path is not None and found is None:
            found = at if at in dirs else None
            if not at:
                break
            at = at.rpartition("/")[0]
        want.append((path, lic, lic or (min(dirs[found])[1] if found is not None else None), None if lic else found))
    assert got and sorted(map(str, want)) == sorted(
        str((r.path, r.own_license, r.license, r.license_dir)) for r in license_scan.scan(table).collect())
    assert {r.path: r.license for r in license_scan.scan(table).collect()}["t/u/v/w.txt"] in ("CC-BY-4.0", "CC-BY-NC-4.0")


NOTICES_ELSEWHERE = [
    ("Licensed under CC BY-ND 4.0.", "CC-BY-ND-4.0"), ("Licensed under CC BY-NC-SA 4.0.", "CC-BY-NC-SA-4.0"), ("Licensed under CC BY-NC-ND 4.0", "CC-BY-NC-ND-4.0"),
    ("Copyright (c) 2020 Jane. Released under the MIT License.", "MIT"), ("© 2021 A. Person. Licensed under the MIT license. All else is reserved.", "MIT"),
    ("SPDX-License-Identifier: ISC", "ISC"), ("// SPDX-License-Identifier: BSD-2-Clause", "BSD-2-Clause"), ("# SPDX-License-Identifier: LGPL-2.1", "LGPL-2.1"),
    ("SPDX-License-Identifier: AGPL-3.0", "AGPL-3.0"), ("SPDX-License-Identifier: Zlib", "Zlib"), ("SPDX-License-Identifier: Foo-9.9", None),
    ("This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free "
     "Software Foundation; either version 2 of the License, or (at your option) any later version.", "GPL-2.0"),
    ("This file is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free "
     "Software Foundation, either version 3 of the License, or (at your option) any later version.", "AGPL-3.0"),
    ("This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the\n"
     "Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.", "LGPL-2.1"),
    ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can "
     "obtain one at http://mozilla.org/MPL/2.0/.", "MPL-2.0"),
    ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:", "BSD"),
    ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\n3. Neither "
     "the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without "
     "specific prior written permission.", "BSD-3-Clause"),
    ("This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.", "CC-BY-ND-4.0"),
    ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "CC-BY-SA-4.0"),
    ("This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy.", "Unlicense"),
    ("Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright "
     "notice and this permission notice appear in all copies.", "ISC"),
    ("Distributed under the Boost Software License, Version 1.0. (See accompanying file)", "BSL-1.0"),
    ("Licensed under the GNU Free Documentation License, version 1.3.", None), ("Licensed under the Foo License, Version 2.0.", None),
    ("Licensed under the Academic Free License, version 3.0.", None), ("Licensed under the GNU General Public License, version 1.", None),
    ("Licensed under CC BY-XX 4.0.", None), ("All rights reserved. No license is granted.", None), ("Licensed under the European Union Public License, version 1.2.", None),
    ("The license of the work is described elsewhere.", None), ("Licensed under CC BY 3.0.", None), ("Licensed under the Microsoft Public License.", None),
]


def test_notices_from_elsewhere(spark):
    """Notices that the given tables do not hold, over the word frequencies of prose: the right licence or none."""
    rng = random.Random(31)
    rows = [(f"p/{i}.txt", prose(rng, 60)) for i in range(300)]
    matcher = license_scan.fit(spark.createDataFrame(rows, "path string, text string"))
    assert len(NOTICES_ELSEWHERE) >= 30
    for text, want in NOTICES_ELSEWHERE:
        assert matcher.best(text)[0] == want, (text, matcher.best(text))
        inside = prose(rng, 30) + ". " + text + "\n\n" + prose(rng, 30)
        assert matcher.best(inside)[0] in (want, None)


def test_license_scan_of_nothing(spark):
    assert license_scan.scan(spark.createDataFrame([], "path string, text string")).count() == 0


# ---- faults of earlier versions ------------------------------------------------------------------


def test_equal_rows_without_ids_share_one_list_of_spans(spark):
    rng = random.Random(8)
    text = prose(rng, 120)
    rows = [(None, text, "en", "s", 0)] * 3000 + [(1, prose(rng, 120), "en", "s", 0)]
    table = spark.createDataFrame(rows, DOCS).repartition(6)
    (row,) = suffix_dedup.repeated_spans(table).collect()
    assert row.id is None and len(row.spans) < 60
    out = suffix_dedup.remove_repeats(table, ["doc_id"]).groupBy("doc_id", "n_bytes", "n_removed").count().collect()
    size = len(text.encode())
    assert {(r.doc_id, r.n_removed, r["count"]) for r in out} == {(None, size, 3000), (1, 0, 1)}


def test_small_payloads_do_not_meet_in_one_task(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        pages = spark.range(4000).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.lit("tiny").alias("html")).repartition(4)
        rows = warc.classify(pages, "page_id", "url", "html").groupBy(F.spark_partition_id()).count().collect()
        assert sum(r["count"] for r in rows) == 4000 and max(r["count"] for r in rows) < 1500
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_every_language_is_learned(spark):
    """More languages than an earlier cap; memory stays within `cells`."""
    from dataclasses import replace

    rows = [(i, f"{chr(0x4E00 + i % 700) * 6} {chr(0x4E00 + i % 700) * 4}", f"l{i % 700}", "s", 0) for i in range(2100)]
    settings = replace(language_id.Settings(), epochs=6, buckets=1 << 12, cells=1 << 21)
    assert settings.for_languages(700).buckets == 1 << 11 and settings.for_languages(4).buckets == 1 << 12
    model = language_id.fit(spark.createDataFrame(rows, DOCS), F.lit(True), settings=settings)
    assert len(model.langs) == 700
    langs, _ = model.predict([t for _, t, _, _, _ in rows[:700]])
    assert sum(a == r[2] for a, r in zip(langs, rows)) > 500


def test_regularised_leader_by_hand():
    """Weights after every epoch against one coordinate at a time."""
    import numpy as np

    rng = random.Random(12)
    s = language_id.Settings(buckets=16, epochs=2, alpha=0.7, beta=0.9, l1=0.03, l2=0.2)
    rows = []
    for _ in range(25):
        at = sorted(rng.sample(range(16), 4))
        rows.append((np.array(at), np.array([rng.random() for _ in at]), rng.randrange(3)))
    z, n = [[0.0] * 3 for _ in range(16)], [[0.0] * 3 for _ in range(16)]

    def weight(b, k):
        if abs(z[b][k]) <= s.l1:
            return 0.0
        return -(z[b][k] - math.copysign(s.l1, z[b][k])) / ((s.beta + math.sqrt(n[b][k])) / s.alpha + s.l2)

    order = np.random.default_rng(7)
    for _ in range(s.epochs):
        for i in order.permutation(len(rows)):
            at, x, y = rows[i]
            logits = [sum(v * weight(b, k) for b, v in zip(at, x)) for k in range(3)]
            top = max(logits)
            e = [math.exp(v - top) for v in logits]
            old = {(b, k): weight(b, k) for b in at for k in range(3)}
            for b, v in zip(at, x):
                for k in range(3):
                    g = v * (e[k] / sum(e) - (k == y))
                    sigma = (math.sqrt(n[b][k] + g * g) - math.sqrt(n[b][k])) / s.alpha
                    z[b][k] += g - sigma * old[b, k]
                    n[b][k] += g * g
    got = language_id._train(rows, 3, s)
    assert all(abs(got[b, k] - weight(b, k)) < 1e-9 for b in range(16) for k in range(3)) and np.any(got == 0) and np.any(got != 0)


def test_components_that_do_not_settle_are_an_error(spark, tmp_path, monkeypatch):
    import itertools

    ticks = itertools.count()
    real = near_dedup.stage
    monkeypatch.setattr(near_dedup, "stage", lambda df, path: real(df.unionByName(spark.createDataFrame([(10_000 + next(ticks), 1)], df.schema)), path))
    monkeypatch.setattr(near_dedup, "ROUNDS", 3)
    with pytest.raises(RuntimeError, match="still change"):
        near_dedup.components(spark.createDataFrame([(1, 2), (2, 3)], "a bigint, b bigint"), str(tmp_path))
