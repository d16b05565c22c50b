"""The queries as they are registered, on the smallest tables, and each stage of the pipeline against brute force."""

import zlib

import corpus_pipeline
import numpy as np
import pytest
from tarnflow import llm
from tarnflow.llm import classifier, langid, packing, pieces_lattice, quality_rules, secret_scan
from tarnflow.llm.common import table

from .helpers import clashing
from .test_rules import plain_counts
from .test_similar import groups
from .test_tokens import library_ids

SF = "/root/testdata/sf0.001"
TYPES = {
    "op1_sentencepiece": "doc_id bigint, n_pieces bigint, ids_crc32 bigint, decodes boolean",
    "op2_quality_rules": "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean",
    "op3_secret_scan": "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string",
    "op4_simhash": "doc_id bigint, fingerprint string, component_id bigint",
    "op5_html_text": "page_id bigint, url string, text string, n_chars bigint",
    "op6_token_file": "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint",
    "op7_language_id": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op8_ann_search": "query_id bigint, rank int, vec_id bigint, score double",
    "op9_packing": "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint",
    "op10_quality_classifier": "doc_id bigint, held_out boolean, score double, predicted int",
}


@pytest.fixture(scope="module")
def documents(spark):
    return [(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in table(spark, SF, "documents").collect()]


@pytest.fixture(scope="module")
def results(spark):
    """The rows of each query, with their schema."""

    class Rows(list):
        schema = None

    out = {}
    for name, query in llm.queries().items():
        df = query(spark, SF)
        out[name] = Rows(df.collect())
        out[name].schema = df.schema
    return out


@pytest.mark.parametrize("name", TYPES)
def test_columns_types_and_rows(spark, results, documents, name):
    kinds = {f.name: f.dataType.simpleString() for f in results[name].schema}
    for column in TYPES[name].split(", "):
        n, kind = column.split(" ")
        assert kinds[n] == kind, n
    ids = sorted(d[0] for d in documents)
    if name in ("op5_html_text", "op8_ann_search"):
        return
    got = sorted({r["doc_id"] for r in results[name]}) if name == "op9_packing" else sorted(r["doc_id"] for r in results[name])
    assert got == ids


def test_held_out_rows(results):
    for name, n, rest in (("op7_language_id", 4, 2), ("op10_quality_classifier", 5, 0)):
        assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % n == rest) for r in results[name])
    assert all(r["predicted"] == (r["score"] >= 0.3) for r in results["op10_quality_classifier"])


def test_token_results_by_the_libraries(results, documents):
    import sentencepiece

    texts = {d[0]: d[1] for d in documents}
    ids = {i: np.array(library_ids(t) + [2], "<u4") for i, t in texts.items()}
    start = 0
    for r in sorted(results["op6_token_file"], key=lambda r: r["doc_id"]):
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids[r["doc_id"]]), zlib.crc32(ids[r["doc_id"]].tobytes()))
        start += r["n_tokens"]
    for r in results["op9_packing"]:
        assert r["ids_crc32"] == zlib.crc32(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]].tobytes()) and r["doc_tokens"] == len(ids[r["doc_id"]])
    model = sentencepiece.SentencePieceProcessor(model_file=pieces_lattice.default_model())
    for r in results["op1_sentencepiece"]:
        want = np.array(model.encode(texts[r["doc_id"]] or ""), "<u4")
        assert (r["n_pieces"], r["ids_crc32"]) == (len(want), zlib.crc32(want.tobytes()))


def test_scores_by_the_fitted_models(spark, results, documents):
    """The queries give what their models say of each text by itself."""
    net = classifier.fit(table(spark, SF, "documents"), table(spark, SF, "labels"))
    scores = {r["doc_id"]: r["score"] for r in results["op10_quality_classifier"]}
    who = langid.fit(table(spark, SF, "documents"))
    langs = {r["doc_id"]: r["lang_pred"] for r in results["op7_language_id"]}
    for i, text, *_ in documents:
        assert abs(scores[i] - classifier.probabilities(net, [text])[0]) < 1e-5
        entropy, n = langid.Scorer(who.models)([text])
        assert langs[i] == (who.names[int(entropy[0].argmin())] if n[0] else "und")


def test_stages_by_brute_force(spark, documents):
    """Each stage on what its predecessor kept."""
    docs = table(spark, SF, "documents")
    stages = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "quality_rules", "simhash_near_dedup", "secret_scan", "packing"]
    rows = lambda df: sorted(tuple(r[c] for c in docs.columns) for r in df.collect())
    assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]

    net = classifier.fit(docs, table(spark, SF, "labels"))
    good = [d for d in documents if classifier.probabilities(net, [d[1]])[0] >= classifier.THRESHOLD]
    got = rows(stages["quality_classifier"](spark, docs, SF))
    assert got == sorted(good) and len(got) < len(documents)

    docs = spark.createDataFrame(got, docs.schema)
    # Pools of so few documents are those of languages, or the rest; the base rules and the cut are checked one by one.
    verdict = {r["doc_id"]: r for r in quality_rules.verdicts(docs).collect()}
    for i, text, *_ in got:
        words, _, _, _, repeats, _ = plain_counts(text)
        failed = words < 20 or 100 * repeats > 30 * words
        far = verdict[i]["distance"]
        assert verdict[i]["base_failed"] == failed and verdict[i]["kept"] == (not failed and (far is None or far**2 <= quality_rules.CUT))
    got = rows(stages["quality_rules"](spark, docs, SF))
    assert got == sorted(x for x in rows(docs) if verdict[x[0]]["kept"])

    docs = spark.createDataFrame(got, docs.schema)
    stay = {w for w in groups(got)}
    got = rows(stages["simhash_near_dedup"](spark, docs, SF))
    assert got == sorted(x for x in rows(docs) if x[0] in stay) and len(got) < docs.count()

    docs = spark.createDataFrame(got, docs.schema)
    spans = {r["doc_id"]: [x.split(":") for x in r["spans"].split(",") if x] for r in secret_scan.scan(docs).collect()}
    result = stages["secret_scan"](spark, docs, SF).collect()
    assert len(result) == len(got)
    texts = {x[0]: x[1] for x in got}
    for r in result:
        text, want, at = texts[r["doc_id"]], "", 0
        for a, b in sorted((int(a), int(b)) for _, a, b in spans[r["doc_id"]]):
            want += text[at:a] + "[secret]" if a >= at else ""
            at = max(at, b)
        assert r["text"] == want + text[at:] and r["n_chars"] == len(r["text"])

    packed = stages["packing"](spark, spark.createDataFrame(result, docs.schema), SF).collect()
    total = {r["doc_id"]: len(library_ids(r["text"])) + 1 for r in result}
    used: dict = {}
    for r in packed:
        used.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
    assert {i: sum(n for _, n in x) for i, x in used.items()} == total
    for x in used.values():
        assert all(a + n == b for (a, n), (b, _) in zip(sorted(x), sorted(x)[1:], strict=False))


def test_the_pipeline_as_registered(spark, documents):
    out = corpus_pipeline.run(spark, SF)
    assert dict(out.dtypes) == {c.split(" ")[0]: "bigint" for c in packing.SCHEMA.split(", ")}
    kept = {r["doc_id"] for r in out.collect()}
    assert 0 < len(kept) < len(documents) and kept <= {d[0] for d in documents}


def test_stages_pass_on_columns_of_any_name(spark):
    docs = clashing(table(spark, SF, "documents"))
    names = [c for c in docs.columns if c not in ("doc_id", "text", "lang", "source", "n_chars")]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, SF)
        assert got.columns == docs.columns and {tuple(r) for r in got.select(*names).distinct().collect()} == {(7,) * len(names)}, name


def test_stages_take_an_empty_table(spark):
    docs = table(spark, SF, "documents").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).collect() == [], name
