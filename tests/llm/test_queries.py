"""Registered queries against SQL or plain versions on the smallest tables, and the pipeline against its parts."""

import hashlib
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
from test_oracle import SF, compare  # noqa: E402

import corpus_pipeline
from seamline.llm import quality, registry, repeats
from test_dedup import brute_repeats, sets


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_as_sql(spark, name):
    compare(spark, registry.queries()[name], registry.oracle_sql()[name])


def test_all_operators_are_registered():
    numbers = sorted(int(n[2:].split("_")[0]) for n in registry.queries())
    assert numbers == list(range(1, 14))


def test_op2_equals_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in registry.queries()["op2_suffix_dedup"](spark, SF).collect()), key=str)
    assert got == brute_repeats(rows)


def library():
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tok.no_truncation()
    tok.no_padding()
    return tok


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def test_op1_equals_the_library(spark):
    tok = library()
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in registry.queries()["op1_bpe_encoding"](spark, SF).collect():
        ids = tok.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), sha(",".join(map(str, ids))))
        assert r.decoded_sha256 == sha(tok.decode(ids, skip_special_tokens=False))


def first_of_classes(rows):
    """doc_ids that stay when classes of similarity 0.8, linked transitively, keep their smallest; by all pairs."""
    rows = sorted(rows)
    own = [sets(t) for _, t in rows]
    total = [sum(c.values()) for c in own]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if root[i] != root[j] and 0.8 * max(total[i], total[j]) <= min(total[i], total[j]):
                both = sum((own[i] & own[j]).values())
                if both and both >= 0.8 * (total[i] + total[j] - both):
                    a, b = sorted((root[i], root[j]))
                    root = [a if r == b else r for r in root]
    return {rows[i][0]: rows[root[i]][0] for i in range(len(rows))}


def test_op7_equals_brute_force(spark):
    want = first_of_classes([(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()])
    got = registry.queries()["op7_minhash_dedup"](spark, SF).collect()
    assert {r.doc_id: r.component_id for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_op6_equals_brute_force(spark):
    import numpy as np

    rows = sorted((r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect())
    v = np.array([r[1] for r in rows], dtype=np.float64)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    near = v @ v.T >= 0.95
    np.fill_diagonal(near, False)
    root = np.arange(len(rows))
    while not (new := np.minimum(root, np.where(near, root[None, :], len(rows)).min(axis=1))).tolist() == root.tolist():
        root = new
    want = [(i, int(near[k].sum()), rows[root[k]][0], bool(root[k] == k)) for k, (i, _) in enumerate(rows)]
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in registry.queries()["op6_embedding_dedup"](spark, SF).collect())
    assert got == want


def test_pipeline_equals_brute_force(spark):
    """Each stage, and run(), against SQL, all pairs, sets of all strings, filled targets and the tokenizers library."""
    import duckdb

    from seamline.llm import q_quality
    from test_models import filled, size

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    source = {r.doc_id: r.source for r in docs.collect()}
    sql = f"WITH src AS (SELECT row_number() OVER () AS rid, doc_id, text FROM '{SF}/documents.parquet'), {q_quality.JUDGED} SELECT doc_id, clean_text FROM src JOIN verdict USING (rid) WHERE NOT base_failed AND NOT lost_much"
    clean = dict(duckdb.sql(sql).fetchall())
    first = corpus_pipeline.quality_rules(spark, docs, SF)
    assert first.columns == docs.columns and {r.doc_id: r.text for r in first.collect()} == clean
    roots = first_of_classes(list(clean.items()))
    stay = {d: t for d, t in clean.items() if roots[d] == d}
    second = corpus_pipeline.near_dedup(spark, first, SF)
    assert second.columns == docs.columns and {r.doc_id: r.text for r in second.collect()} == stay
    seen, left = set(), {}
    for d in sorted(stay):
        raw = stay[d].encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - 99):
            if raw[p : p + 100] in seen:
                gone[p : p + 100] = b"\1" * 100
            seen.add(raw[p : p + 100])
        rest = bytes(c for c, g in zip(raw, gone, strict=True) if not g)
        if rest or not raw:
            left[d] = rest.decode(errors="ignore") if sum(gone) else stay[d]
    third = corpus_pipeline.passage_dedup(spark, second, SF)
    assert third.columns == docs.columns and {r.doc_id: r.text for r in third.collect()} == left
    out = corpus_pipeline.run(spark, SF).collect()
    tok, taken, sizes = library(), {}, {}
    for d, t in left.items():
        sizes[source[d]] = sizes.get(source[d], 0) + size(t)
    for r in out:
        ids = tok.encode(left[r.doc_id], add_special_tokens=False).ids
        assert (r.ids, r.n_tokens, r.source) == (ids, len(ids), source[r.doc_id])
        assert r.ids_sha256 == sha(",".join(map(str, ids))) and r.decoded_sha256 == sha(left[r.doc_id])
        taken[r.doc_id] = taken.get(r.doc_id, 0) + 1
    assert max(taken.values()) <= 2
    for s, goal in filled(sizes, (3, 1, 2), 1.5, 2).items():
        own = [d for d in left if source[d] == s]
        assert abs(sum(taken.get(d, 0) * size(left[d]) for d in own) - goal) <= max(min(size(left[d]) for d in own), 0.01 * goal)
    assert corpus_pipeline.ORACLE_SQL is None and 4 <= len(corpus_pipeline.STAGES) <= 5


#: Names that operators use on their way, or add.
CLASHES = "rate n_bytes size digest src bucket place every more spans copy copies taken target _id _fp _doc _z _spans _rest _f _w _l _h _all _good kept clean_text n_tokens ids user_3 a.b".split()
EXTRA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHES)


def edge_rows():
    long = " ".join(f"word{i}," for i in range(30_000)) + "."
    said = "A sentence that is long enough to be kept, with commas, and a full stop at its end."
    texts = [(1, None), (2, ""), (3, " \n "), (None, said), (4, said), (4, said), (5, said + " More of it."), (6, long), (7, long)]
    return [(d, t, None, None if d == 5 else "s", None, *[f"my {c}" for c in CLASHES]) for d, t in texts]


def test_pipeline_stages_take_edge_cases(spark):
    docs = spark.createDataFrame(edge_rows(), EXTRA)
    some = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name != "token_ids":
            assert out.dtypes == docs.dtypes
            assert all(r[c] == f"my {c}" for r in out.collect() for c in CLASHES)
        some[name] = sorted(((r.doc_id or 0, len(r.text or "") if name != "token_ids" else r.n_tokens) for r in out.collect()))
    n, long = len(edge_rows()[3][1]), len(edge_rows()[7][1])
    assert [d for d, _ in some["quality_rules"]] == [0, 4, 4, 5, 6, 7]
    assert [d for d, _ in some["near_dedup"]] == [0, 1, 2, 3, 6]
    assert some["passage_dedup"] == [(0, n), (1, 0), (2, 0), (3, 3), (4, n), (4, n), (5, n + 12), (6, long)]
    assert {(1, 0), (2, 0), (3, 3)} <= set(some["source_mix"]) and {d for d, _ in some["source_mix"]} >= {1, 2, 3, 5}
    assert len(some["token_ids"]) == len(edge_rows()) and some["token_ids"][1:3] == [(1, 0), (2, 0)]


def test_pipeline_stages_take_an_empty_table(spark):
    docs = spark.createDataFrame(edge_rows(), EXTRA).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0


def test_operators_take_columns_that_clash(spark):
    from seamline.llm import bpe, minhash, mixing

    docs = spark.createDataFrame(edge_rows(), EXTRA)
    added = {
        "op1": ["n_tokens", "ids", "decoded"],
        "op2": ["n_bytes", "n_removed", "n_spans", "kept_sha256"],
        "op3": list(mixing.ADDED),
        "op10": ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "lost_chars", "clean_text", "kept"],
    }
    outs = {"op1": bpe.encode_documents(docs.drop("a.b")), "op2": repeats.remove(docs), "op3": mixing.mix(docs), "op10": quality.judge(docs)}
    for name, out in outs.items():
        stay = [c for c in CLASHES if c not in added[name] and (name != "op1" or c != "a.b")]
        assert set(out.columns) >= {*stay, *added[name], "doc_id"}
        rows = out.collect()
        assert len(rows) == len(edge_rows()) and all(r[c] == f"my {c}" for r in rows for c in stay)
    assert minhash.classify(docs).count() == len({(d, t) for d, t, *_ in edge_rows()})


def test_rows_under_repeats_keep_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert repeats.remove(docs, give_text=True).columns == [*docs.columns, "n_bytes", "n_removed", "n_spans"]
