"""The stages of the corpus pipeline, each against a plain version on its own input."""

import random

import corpus_pipeline as cp
import pytest
from brute import contamination, cut, near, statistics, words
from pyspark.sql import functions as F

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def prose(rng, n):
    return " ".join(rng.choice("abcdefgh") + rng.choice("aeiou") + rng.choice("lmnprst") + str(rng.randint(0, 30)) for _ in range(n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Documents with junk, copies, edits, shared passages and leaks; labels and a benchmark."""
    rng = random.Random(41)
    rows, marks = [], []
    passage, leak = prose(rng, 60), prose(rng, 15)
    for i in range(160):
        text = prose(rng, rng.randint(40, 120))
        if i % 5 == 0:
            text = text.replace(" ", "## ")
        elif i % 11 == 0:
            text = passage + " " + text
        elif i % 13 == 0:
            text += "\n" + leak
        rows.append(text)
        marks.append((i, int(i % 5 != 0), 0))
    rows += [rows[1], rows[1], rows[2].replace(rows[2].split()[9], "changed"), "short", None, "", "word " * 60]
    out = tmp_path_factory.mktemp("corpus")
    docs = [(i, t, "en", f"s{i % 4}", len(t or "")) for i, t in enumerate(rows)]
    spark.createDataFrame(docs, DOCS).write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame(marks, "doc_id bigint, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    spark.createDataFrame([(7, leak), (8, "nowhere to be found at all")], "item_id bigint, text string").write.parquet(f"{out}/benchmark.parquet")
    return str(out), dict(enumerate(rows))


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_stages_one_after_the_other(spark, folder, tmp_path):
    path, all_texts = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    assert [n for n, _ in cp.STAGES] == ["quality rules", "near-duplicates", "repeated passages", "benchmark decontamination", "source mixture"]

    good = cp.keep_quality(spark, docs, path)
    assert good.columns == docs.columns
    kept = texts(good)
    # Junk and what fails the base limits goes, clean documents stay.
    assert set(kept) == {i for i, t in all_texts.items() if "##" not in (t or "") and not statistics(t)[5]}

    alone = cp.drop_near_duplicates(spark, good, path)
    assert alone.columns == docs.columns
    comp = near(kept, 5)
    chosen = texts(alone)
    assert set(chosen) == {i for i, (_, c) in comp.items() if i == c}

    whole = cp.cut_repeats(spark, alone, path)
    left = texts(whole)
    ids = sorted(chosen)
    want = {}
    for i, (_, gone, _, rest) in zip(ids, cut([chosen[i] for i in ids], 200)):
        text = rest.decode("utf-8", "ignore") if gone else chosen[i]
        if not gone or words(text):
            want[i] = text
    assert left == want and any(len(left[i]) < len(chosen[i]) for i in left)
    assert all(r.n_chars == len(r.text) for r in whole.collect() if len(r.text) != len(chosen[r.doc_id]))

    clean = cp.drop_contaminated(spark, whole, path)
    hits = contamination([left[i] for i in sorted(left)], [(7, all_texts[13].split("\n")[1]), (8, "nowhere to be found at all")])
    assert texts(clean) == {i: left[i] for i, (_, n, _) in zip(sorted(left), hits) if n == 0}
    assert clean.count() < whole.count()

    mixed = cp.mix_sources(spark, clean, path)
    assert set(docs.columns) <= set(mixed.columns) and set(texts(mixed)) <= set(texts(clean))


def test_run_equals_its_stages(spark, folder):
    path, _ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for _, stage in cp.STAGES:
        docs = stage(spark, docs, path)
    cols = ["doc_id", "text", "copy"]
    assert sorted(map(str, cp.run(spark, path).select(cols).collect())) == sorted(map(str, docs.select(cols).collect()))


def test_stages_of_odd_tables(spark, folder, tmp_path):
    """Empty tables, rows that repeat, null ids and an extra column with a clashing name."""
    path, _ = folder
    empty = spark.createDataFrame([], DOCS)
    for _, stage in cp.STAGES:
        assert stage(spark, empty, path).count() == 0
    text = prose(random.Random(1), 60)
    rows = [(1, text, None, None, 1), (1, text, None, None, 1), (None, text + " x", None, None, 1), (None, prose(random.Random(2), 50), None, "s", 1)]
    odd = spark.createDataFrame(rows, DOCS).withColumns({"kept": F.lit(1), "n_words": F.lit(2), "id": F.lit(3), "spans": F.lit(4)})
    for _, stage in cp.STAGES[:4]:
        out = stage(spark, odd, path)
        assert out.columns == odd.columns
    alone = cp.drop_near_duplicates(spark, odd, path).collect()
    assert sorted(str(r.doc_id) for r in alone) == ["1", "None"] and len({r.text for r in alone}) == 2


def test_other_columns_keep_their_values(spark, folder):
    """Columns with the names that operators add or use inside come through every stage untouched."""
    path, _ = folder
    names = ["s_url", "kept", "rule", "base_failed", "n_words", "n_hit", "n_items", "items", "n_bytes", "n_removed", "n_spans", "kept_text",
             "text_key", "_id", "_key", "_k", "id", "th", "spans", "other_0", "a.b", "component_id"]
    docs = spark.read.parquet(f"{path}/documents.parquet").where("doc_id is not null")
    wide = docs.select("*", *[F.concat(F.lit(f"{n}:"), "doc_id").alias(n) for n in names])
    for name, stage in cp.STAGES:
        out = stage(spark, wide, path)
        assert out.columns[: len(wide.columns)] == wide.columns, name
        rows = out.collect()
        assert rows and all(r[n] == f"{n}:{r['doc_id']}" for r in rows for n in names), name
