"""The registered queries run over whole tables and agree with their SQL; the pipeline keeps its promises."""

import collections
import hashlib
import random

import pytest

from seawake.llm import mixing, pii
from tests.conftest import rows_of
from tests.llm.test_operators import brute_classes, plain_resampling, plain_schedule, split


@pytest.fixture(scope="module")
def entry():
    import __spark_entry__

    if __spark_entry__.llm is None:
        pytest.skip("the training-data operators are not here")
    return __spark_entry__


@pytest.mark.parametrize("name", ["op1_warc", "op3_license_scan", "op4_ngram_jaccard_join", "op6_quality_rules", "op8_substring_dedup", "op10_source_mixing"])
def test_query_equals_sql(spark, small, oracle, entry, name):
    got = entry.queries()[name](spark, small).toArrow()
    want = oracle(entry.oracle_sql()[name])
    assert sorted(got.column_names) == sorted(want.column_names)
    assert rows_of(got) == rows_of(want)


def test_every_operator_has_a_query(entry):
    numbers = {int(n[2:].split("_")[0]) for n in entry.queries() if n.startswith("op")}
    assert numbers == set(range(1, 11)) and "pipeline" in entry.queries()


def test_pipeline_stages(spark, small):
    import corpus_pipeline

    docs = spark.read.parquet(f"{small}/documents.parquet")
    names = []
    for name, stage in corpus_pipeline.STAGES:
        names.append(name)
        before = docs
        docs = stage(spark, docs, small)
        if name != "packing":
            assert docs.columns == before.columns
            docs = spark.createDataFrame(docs.toArrow())
    assert names == ["quality", "near duplicates", "pii", "mixture", "packing"]
    pieces = docs.toPandas()
    assert pieces.groupby("sequence_id").length.sum().max() <= 2048 and len(pieces)


def plain_mix(rows, block=mixing.BLOCK_WORDS):
    """{doc_id: passes that take any of its words} of (doc_id, text, source) rows with distinct ids."""
    sizes = collections.Counter()
    for _, text, source in rows:
        sizes[source] += len(split(text))
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    targets = mixing.water_fill([sizes[n] for n in names], [1 + i % 3 for i in range(len(names))])
    Plan = collections.namedtuple("Plan", "source_no source_size wanted blocks slots")
    plan = []
    for i, (n, t) in enumerate(zip(names, targets)):
        size, wanted, blocks = sizes[n], round(t), -(-sizes[n] // block)
        plan.append(Plan(i, size, wanted, blocks, wanted // size * blocks + -(-(wanted % size) // block) if size else 0))
    slots = collections.defaultdict(list)
    for _, source, no, words, turn in plain_schedule(plan, block, mixing.GOLDEN):
        slots[source, no].append((words, turn))
    passes, at = collections.Counter(), collections.Counter()
    for doc, text, source in sorted(rows, key=lambda r: hashlib.md5(f"mix-{r[0]}".encode()).hexdigest()):
        no, size = names.index(source), len(split(text))
        start = at[no]
        at[no] += size
        taken = set()
        for b in range(start // block, (start + size - 1) // block + 1) if size else ():
            taken |= {turn for words, turn in slots[no, b] if min(start + size, b * block + words) > max(start, b * block)}
        passes[doc] = len(taken)
    return passes


def test_pipeline_equals_brute_force(spark, tmp_path, entry):
    # Near and exact copies, a repeated row, nulls in every column but the id of rows with words, an empty text, a very long one, personal data, columns of other names.
    rng = random.Random(21)
    vocabulary = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(160):
        good = rng.random() < 0.8
        words = [rng.choice(vocabulary) if good else rng.choice(["###", "AB!!", "%%%x"]) for _ in range(rng.randint(1, 90))]
        rows.append([i, " ".join(words), rng.choice(["en", None]), rng.choice(["s1", "s2", None]), len(words)])
    for i in range(160, 220):
        words = rng.choice(rows[:160])[1].split(" ")
        if len(words) > 40 and rng.random() < 0.6:
            words[rng.randrange(len(words))] = "changed"
        rows.append([i, " ".join(words), "en", rng.choice(["s1", "s2"]), None])
    rows += [[220, None, None, None, None], [221, "", "en", "s1", 0], [222, " ".join(rng.choice(vocabulary) for _ in range(9000)), "en", "s1", 1], [223, "w1 w2 mail jo@a.example.org w3 on 2021-03-04", "en", "s2", 1]]
    rows.append(rows[7])
    labels = [(r[0], int("#" not in (r[1] or "") and "AB!!" not in (r[1] or "")), 0) for r in rows[:160] if r[0] % 2]
    spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, node string, slot int").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = entry.queries()["pipeline"](spark, str(tmp_path)).collect()

    _, kept, _ = plain_resampling([(r[0], r[1]) for r in rows], labels)
    rows = [r for r, k in zip(rows, kept) if k]
    component = {d: c for d, n, c in brute_classes([(r[0], r[1]) for r in rows], 5, 80, 100) if n}
    rows = [r for i, r in enumerate(rows) if (not split(r[1]) or component[r[0]] == r[0]) and r not in rows[:i]]
    key = pii.session_key(spark)
    rows = [(r[0], r[1] if r[1] is None else pii.pseudonymize(r[1], key)[0], r[3]) for r in rows]
    passes = plain_mix(rows)
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    tokens = {d: len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 for d, t, _ in rows}
    want = {d: passes[d] * tokens[d] for d in tokens if passes[d]}
    found, filled = collections.Counter(), collections.Counter()
    for r in got:
        assert r.doc_tokens == tokens[r.doc_id]
        found[r.doc_id] += r.length
        filled[r.sequence_id] += r.length
    assert dict(found) == want
    assert sum(filled.values()) == sum(want.values()) and all(n == 2048 or n & (n - 1) == 0 for n in filled.values())


def test_pipeline_of_empty_tables(spark, tmp_path, entry):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert entry.queries()["pipeline"](spark, str(tmp_path)).count() == 0
