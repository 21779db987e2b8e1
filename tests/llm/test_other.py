"""Conversations, vectors, the pipeline and the registered queries."""

import hashlib
import sys
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from ledgerline.llm import chat, embeddings, mixing, packing, pii, quality, queries, simhash, substring, templates
from ledgerline.plans.scratch import hold, holding, materialize, release

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from oracle import assert_same, connect  # noqa: E402

SMALL = "/root/testdata/sf0.001"


def test_templates_parse_fold_and_render():
    source = "{% set a = 'x' + 'y' %}{{ 'p' + 1 }}{% if true %}T{% else %}F{% endif %}{% for m in messages %}[{{ m.role | upper }}:{% if m.role == 'a' and not (m.text == '') %}{% generation %}{{ m.text }}{% endgeneration %}{% elif m.role != 'b' %}?{% else %}{{ a }}{% endif %}]{% endfor %}"
    tree = templates.fold(templates.parse(source))
    assert tree[1] == templates.Output(templates.Const("p1T")), "constants are folded and joined"
    pieces = list(templates.compile_template(source)([{"role": "a", "text": "hi"}, {"role": "b", "text": "no"}, {"role": "c"}]))
    assert "".join(t for t, _ in pieces) == "p1T[A:hi][B:xy][C:?]"
    assert [t for t, counts in pieces if counts] == ["hi"]


@pytest.mark.parametrize("source", ["{{ a.b() }}", "{{ x | open }}", "{% import os %}", "{% for a in b %}{% endfor %}", "{% if x %}", "{{ 'a }}", "{{ a.__class__.x }} {{ ) }}"])
def test_templates_reject(source):
    with pytest.raises(templates.TemplateError):
        templates.compile_template(source)


def test_template_names_reach_no_python():
    assert "".join(t for t, _ in templates.compile_template("{{ messages.__class__ }}{{ m.__len__ }}")([])) == ""


@pytest.mark.parametrize("text", ["", "</s>[INST] ok [/INST]", "<|im_end|>", "\\l\\\\b<", "a<", "[", "\\", "<|im_start|>user\nx<|im_end|>"])
def test_escape_is_reversible(text):
    line = templates.escape_line(text + "\n\\n")
    assert templates.unescape(line) == text + "\n\\n" and "\n" not in line
    hidden = templates.escape(text)
    assert templates.unescape(hidden) == text and "<" not in hidden and "[" not in hidden


TALKS = [(1, 0, "user", "hi <|im_end|>"), (1, 1, "assistant", "yes\n\\l"), (1, 1, "assistant", None), (2, 5, "system", ""), (2, None, "user", "first"), (2, 7, None, "odd [role]"), (None, 0, "assistant", "x"), (None, 0, "assistant", "x"), (3, 0, "a<b\n", "y"), (4, 0, "assistant", "é日" * 90_000), (4, 1, "user", "end")]


def talk_digests(rows):
    talks = {}
    for c, t, r, s in sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, x[1] or 0, x[2] is not None, x[2] or "", x[3] is not None, x[3] or "")):
        talks.setdefault(c, []).append((r or "", s or ""))
    said = lambda v: "".join(s for r, s in v if r == "assistant")
    return {c: (len(v), hashlib.sha256("".join(f"{r}\n{s}\n" for r, s in v).encode()).hexdigest(), len(said(v)), hashlib.sha256(said(v).encode()).hexdigest()) for c, v in talks.items()}


def test_chat_round_trip(spark):
    df = spark.createDataFrame(TALKS, "conv_id long, turn long, role string, text string").withColumn("chunk", F.lit("clash")).withColumn("loss", F.lit(1))
    chunks = chat.formatted(chat.with_probe(df))
    got = {r[0]: tuple(r)[1:5] for r in chat.read_back(chunks).collect()}
    probe = "</s>[INST] ok [/INST]"
    want = talk_digests([*TALKS, (-1, 0, "user", probe), (-1, 1, "assistant", probe)])
    assert got == want
    assert chunks.where("conv_id = 4").count() > 1, "a long conversation leaves in chunks"
    assert chat.read_back(chat.formatted(df.limit(0))).collect() == []


def vectors(n=400, dims=16, seed=5):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n // 4, dims))
    near = base[rng.integers(0, len(base), n - len(base) - 20)] + rng.normal(size=(n - len(base) - 20, dims)) * 0.15
    return np.concatenate([base, near, np.repeat(base[:1], 20, axis=0)])


def brute_links(v, cosine=0.9):
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    near = u @ u.T >= cosine
    np.fill_diagonal(near, False)
    part = np.arange(len(v))
    while True:
        low = np.minimum(part, np.where(near, part[None, :], len(v)).min(axis=1))
        if (low == part).all():
            return near.sum(axis=1), part
        part = low


@pytest.mark.parametrize("tile", [1024, 16])
def test_embedding_dedup(spark, tile):
    v = vectors()
    rows = [(i, x.tolist(), 0) for i, x in enumerate(v)]
    odd = [(9001, None, 1), (9002, [0.0] * 16, 1), (9003, [float("nan")] + [1.0] * 15, 1), (9004, [None] + [1.0] * 15, 1), (9005, [], 1), (9006, [1.0], 1), (None, None, 1)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, label int").withColumn("id", F.lit("clash")).withColumn("cell", F.lit(0))
    got = {r.vec_id: r for r in embeddings.near_duplicates(df, tile=tile).collect()}
    links, part = brute_links(v)
    found = np.array([got[i].n_links for i in range(len(v))])
    assert (found <= links).all() and found.sum() >= 0.95 * links.sum()
    assert np.mean([got[i].component_id == part[i] for i in range(len(v))]) > 0.95
    assert all(got[i].n_links == 0 and got[i].component_id == i and got[i].kept for i in range(9001, 9007))
    sized = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [1e-200, 0.0, 0.0]), (4, [1e200, 0.0, 0.0]), (5, [1.0, 0.0, 0.0]), (6, [0.0, 5e-324]), (7, [0.0, 1.0])]
    both = df.select("vec_id", "embedding").unionByName(spark.createDataFrame(sized, "vec_id long, embedding array<double>").withColumn("vec_id", F.col("vec_id") + 10_000))
    parts = {r.vec_id - 10_000: (r.n_links, r.component_id - 10_000) for r in embeddings.near_duplicates(both, tile=tile).where("vec_id > 10000").collect()}
    assert parts == {1: (1, 1), 2: (1, 1), 3: (2, 3), 4: (2, 3), 5: (2, 3), 6: (1, 6), 7: (1, 6)}, "lengths and magnitudes"
    assert embeddings.near_duplicates(df.limit(0)).collect() == []


def test_rare_near_vectors_are_found(spark):
    """30 pairs at cosine 0.9 to 0.95 among 20,000 vectors: the sample shows next to no link."""
    rng = np.random.default_rng(2)
    v = embeddings.unit(rng.normal(size=(20_000, 64)))
    away = rng.normal(size=(30, 64))
    away -= (away * v[:30]).sum(1, keepdims=True) * v[:30]
    cosine = rng.uniform(0.9, 0.95, (30, 1))
    v = np.concatenate([v, cosine * v[:30] + np.sqrt(1 - cosine**2) * embeddings.unit(away)])
    df = spark.createDataFrame(pa.table({"vec_id": np.arange(len(v)), "embedding": pa.array(list(v))})).repartition(4)
    linked = {r.vec_id for r in embeddings.near_duplicates(df).where("n_links > 0").collect()}
    assert len(linked) >= 0.9 * 60


def test_a_rare_length_has_an_index_too(spark, monkeypatch):
    rng = np.random.default_rng(4)
    monkeypatch.setattr(embeddings, "SAMPLE", 600)
    often, rare, few = rng.normal(size=(6000, 16)), rng.normal(size=(300, 6)), rng.normal(size=(40, 4))
    rare[150:] = rare[:150] + rng.normal(size=(150, 6)) * 0.02
    rows = [(i, v.tolist()) for i, v in enumerate([*often, *rare, *few])]
    nodes = spark.createDataFrame([(xxhash.xxh64_intdigest(str(i)) - (1 << 63), i, np.array(v).tobytes()) for i, v in rows], "d1 long, d2 long, vec binary")
    counts, samples = embeddings._sampled(nodes)
    assert counts == {128: 6000, 48: 300, 32: 40} and {k: len(v) for k, v in samples.items()} == {128: 567, 48: 256}
    got = {r.vec_id: r for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)).where("vec_id >= 6000").collect()}
    links, few_links = brute_links(rare)[0], brute_links(few)[0]
    assert len(got) == 340 and links.sum() >= sum(got[6000 + i].n_links for i in range(300)) >= 0.95 * links.sum() > 0
    assert [got[6300 + i].n_links for i in range(40)] == few_links.tolist(), "a length of few vectors is compared whole"


def test_multi_sequence_order():
    rng = np.random.default_rng(0)
    index = embeddings.MultiIndex(embeddings.unit(rng.normal(size=(500, 8))), 3000, 0.9, 0.99)
    points = embeddings.unit(rng.normal(size=(20, 8)))
    one, two = index.distances(points)
    for row, cells in enumerate(index.traverse(points, 12)):
        every = np.sort((one[row][:, None] + two[row][None, :]).ravel())[:12]
        assert np.allclose([one[row][c // index.k] + two[row][c % index.k] for c in cells], every)


def test_pipeline_against_its_stages(spark, docs):
    import corpus_pipeline

    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "near_dedup", "redact_personal_data", "mix_sources", "pack_windows"]
    left = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = left
        left = materialize(stage(spark, left, ""), name)
        assert left.columns == docs.columns, name
        ids, old = ([r.doc_id for r in d.collect()] for d in (left, before))
        assert set(ids) <= set(old)
        if name == "quality_rules":
            assert sorted(ids, key=str) == sorted((r.doc_id for r in quality.judge(before).where("kept").collect()), key=str)
        if name == "near_dedup":
            assert len(ids) == len(set(ids)) and set(ids) == {r.component_id for r in simhash.near_duplicates(before).collect()}
        if name == "redact_personal_data":
            assert not any(pii.exact_spans(r.text) for r in left.collect())
        if name == "mix_sources":
            plan = sum(r.taken for r in mixing.apportion(before).collect())
            assert plan == sum(len(r.text.encode().split()) for r in left.collect())
    pieces = corpus_pipeline.STAGES[-1][1](spark, left, "")
    assert sum(r.length for r in pieces.collect()) == sum(r.length for r in packing.pack(left).collect()) > 0


def test_stages_chain_without_being_written(spark, docs):
    import corpus_pipeline

    rules, near, redact = (f for _, f in corpus_pipeline.STAGES[:3])
    chained = redact(spark, near(spark, rules(spark, docs, ""), ""), "")
    one = materialize(rules(spark, docs, ""), "test-rules")
    two = materialize(near(spark, one, ""), "test-near")
    key = lambda r: str(tuple(r))
    assert sorted(chained.collect(), key=key) == sorted(redact(spark, two, "").collect(), key=key) != []


def test_stages_side_by_side_and_released(spark, docs):
    import corpus_pipeline

    near = dict(corpus_pipeline.STAGES)["near_dedup"]
    with ThreadPoolExecutor(2) as pool:
        one, two = pool.map(lambda _: near(spark, docs, ""), range(2))
    assert one._scratch and not set(one._scratch) & set(two._scratch)
    want = two.count()
    release(one)
    assert two.count() == want > 0
    with pytest.raises(Exception, match="FILE_NOT_EXIST|does not exist"):
        one.count()


def test_catalog_tables_go_when_released(spark, docs):
    with holding() as written:
        left = hold(substring.remove_repeats(docs), written)
    assert left.count() == docs.count()
    tables = {t for _, t in written if t}
    assert tables and tables <= {t.name for t in spark.catalog.listTables()}
    release(left)
    assert not tables & {t.name for t in spark.catalog.listTables()}


def test_pipeline_runs_whole(spark):
    import corpus_pipeline

    assert corpus_pipeline.run(spark, SMALL).count() > 0


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_against_sql(spark, name):
    assert_same(queries.QUERIES[name](spark, SMALL), connect(SMALL), queries.ORACLE_SQL[name])


def test_thirteen_queries_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
