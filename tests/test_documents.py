import random
import time

import numpy as np
import pyarrow as pa
import pytest

from rollbook.operators import documents as d
from rollbook.operators import entity_graph as eg
from rollbook.operators import questions as q
from rollbook.operators import vectors


def fold(elements, max_chars=1500, overlap=200):
    """Plain form of the chunk rules."""
    out, buf, meta = [], "", None
    for kind, text, page in elements:
        text = text.strip()
        if kind in d.STRUCTURAL:
            if buf:
                out.append((buf.strip(), *meta))
            out.append((text, kind, page))
            buf, meta = "", None
            continue
        meta = meta or (kind, page)
        while len(text) > max_chars:
            if buf:
                out.append((buf.strip(), *meta))
            out.append((text[:max_chars].strip(), kind, page))
            text, buf, meta = text[max_chars - overlap:], "", (kind, page)
        if len(buf) + len(text) > max_chars:
            if buf:
                out.append((buf.strip(), *meta))
                buf, meta = buf[-overlap:] + "\n" + text, (kind, page)
            else:
                buf = text
        else:
            buf += "\n" + text
    if buf.strip():
        out.append((buf.strip(), *meta))
    return out


def chunk(spark, elements, **kw):
    df = spark.createDataFrame([(1, elements)], "doc_id long, elements array<struct<type:string,text:string,page:int>>")
    rows = sorted(d.chunks(df, **kw).collect(), key=lambda r: r.chunk_index)
    assert [r.chunk_index for r in rows] == list(range(len(rows)))
    return [(r.text, r.element_type, r.page) for r in rows]


def test_chunk_cases(spark):
    assert chunk(spark, []) == []
    assert chunk(spark, [("paragraph", "Hello world", 1)]) == [("Hello world", "paragraph", 1)]
    assert chunk(spark, [("table", "| A |\n|---|", 1)]) == [("| A |\n|---|", "table", 1)]
    assert len(chunk(spark, [("paragraph", "word " * 500, 1)], max_chars=1000)) >= 2
    assert chunk(spark, [("heading", "Chapter 1", 1), ("paragraph", "Content", 2)]) == [("Chapter 1", "heading", 1), ("Content", "paragraph", 2)]
    assert chunk(spark, [("paragraph", "First.", 1), ("paragraph", "Second.", 1)]) == [("First.\nSecond.", "paragraph", 1)]


def test_chunks_equal_plain_fold(spark):
    rng = random.Random(5)
    docs = []
    for i in range(60):
        els = []
        for _ in range(rng.randrange(1, 25)):
            kind = rng.choice(["paragraph", "paragraph", "paragraph", "list", "table", "heading", "code"])
            n = rng.choice([0, 1, 5, 40, 90, 99, 100, 101, 180, 181, 260, 500])
            els.append((kind, "".join(rng.choice("ab c") for _ in range(n)), rng.randrange(3)))
        docs.append((i, els))
    df = spark.createDataFrame(docs, "doc_id long, elements array<struct<type:string,text:string,page:int>>")
    got = {}
    for r in d.chunks(df, 100, 20).orderBy("doc_id", "chunk_index").collect():
        got.setdefault(r.doc_id, []).append((r.text, r.element_type, r.page))
    for i, els in docs:
        assert got.get(i, []) == fold(els, 100, 20), i


def test_chunking_is_linear():
    """A text ten times as long takes about ten times as long, not a hundred times."""
    def seconds(n):
        texts = [f"line {i} of a long text with some words in it" for i in range(n)]
        t0 = time.perf_counter()
        out = d.chunk_elements(texts, ["paragraph"] * n, [1] * n)
        assert sum(len(t) for t, _, _ in out) >= sum(map(len, texts))
        return time.perf_counter() - t0

    seconds(1000)
    assert seconds(200_000) < 40 * max(seconds(20_000), 0.02)  # the longer one holds 9 MB


def test_windows(spark):
    long = [(1, i, "x" * 900 + "\n" + "y" * 100) for i in range(12)] + [(2, 0, "short")]
    rows = d.triplet_windows(spark.createDataFrame(long, "doc_id long, chunk_index int, text string"), first=1).orderBy("doc_id", "part").collect()
    assert [(r.doc_id, r.max_triplets) for r in rows] == [(1, 5)] * 3 + [(2, 20)]
    assert "".join(r.text for r in rows if r.doc_id == 1) == "\n".join(t for _, i, t in long[:10]) + "\n"
    assert all(len(r.text) <= 4001 for r in rows)


def test_windows_of_the_whole_text(spark):
    long = [(1, i, f"{i} " + "x" * 900 + "\n" + "y" * 100) for i in range(32)] + [(2, 0, "short")]
    rows = d.triplet_windows(spark.createDataFrame(long, "doc_id long, chunk_index int, text string")).orderBy("doc_id", "window", "part").collect()
    of = lambda w: "".join(r.text for r in rows if (r.doc_id, r.window) == (1, w)).rstrip("\n")
    assert [of(w) for w in range(4)] == ["\n".join(t for k, i, t in long if k == 1 and i // 10 == w) for w in range(4)]
    assert [(r.window, r.part, r.max_triplets, r.text) for r in rows if r.doc_id == 2] == [(0, 0, 20, "short")]


def test_confidence(spark):
    answers = spark.createDataFrame([(1, "x" * 250, True), (2, "short", False), (3, "none", False)], "answer_id long, answer string, graph_used boolean")
    hits = spark.createDataFrame([(1, 1, 0.92), (1, 2, 0.87), (1, 3, 0.81), (2, 1, 0.12)], "answer_id long, rn int, score double")
    got = {r.answer_id: r for r in d.confidence(answers, hits).collect()}
    assert got[1].confidence_score == round((0.92 + 0.87 + 0.81) / 3 * 0.65 + 0.06 + 0.05 + 0.1, 4) and got[1].weak_claims == []
    assert got[2].confidence_score < 0.5 and len(got[2].weak_claims) == 2 and got[3].confidence_score == 0.0


POINTS = "point_id long, vector array<double>, document_id string, scheme_id string"
REQUESTS = "query_id long, vector array<double>, document_ids array<string>, scheme_id string"


def brute_search(qs, pts, k):
    out = {}
    for qid, v, docs, scheme in qs:
        if v is None:
            continue
        hits = []
        for pid, w, doc, s in pts:
            if w is not None and (docs is None or doc in docs) and (scheme is None or s == scheme):
                norm = np.linalg.norm(v) * np.linalg.norm(w)
                hits.append((-round(float(np.dot(v, w)) / norm, 9) if norm else 0.0, pid))
        out[qid] = [(p, -s) for s, p in sorted(hits)[:k]]
    return out


def found_by(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rn)):
        out.setdefault(r.query_id, []).append((r.point_id, r.score))
    return out


@pytest.mark.parametrize("broadcast", [True, False])
def test_vector_search_and_filters(spark, monkeypatch, broadcast):
    """Requests by the hundred, ties, equal vectors, nulls and filters, sent to the tasks or paired."""
    monkeypatch.setattr(vectors, "BROADCAST_BYTES", 1 << 20 if broadcast else 0)
    rng = np.random.default_rng(0)
    m = rng.normal(size=(900, 8))
    m[400:700] = m[7]  # a vector that a third of the points share
    m[800] = 0
    pts = [(i, m[i].tolist(), f"D{i % 4}" if i % 9 else None, "S1" if i % 2 else None) for i in range(900)] + [(2000, None, "D1", "S1")]
    qs = [(i, m[i].tolist(), None, None) for i in range(0, 900, 5)]
    qs += [(1001, m[9].tolist(), ["D1", "D2"], None), (1002, m[7].tolist(), None, "S1"), (1003, m[7].tolist(), ["D0"], "S1"), (1004, m[7].tolist(), [], None), (1005, m[7].tolist(), ["none"], None), (1006, None, None, None), (1007, m[7].tolist(), None, "S9")]
    points = spark.createDataFrame(pts, POINTS).repartition(5)
    found = found_by(vectors.vector_search(spark.createDataFrame(qs, REQUESTS).repartition(3), points, 6))
    want = {q: hits for q, hits in brute_search(qs, pts, 6).items() if hits}
    assert {q: [p for p, _ in hits] for q, hits in found.items()} == {q: [p for p, _ in hits] for q, hits in want.items()}
    assert all(np.allclose([s for _, s in found[q]], [s for _, s in want[q]], atol=2e-9) for q in want)


def test_vector_search_over_small_blocks(spark, monkeypatch):
    """Blocks of a few rows, and fewer held blocks than there are requests, give the same rows."""
    monkeypatch.setattr(vectors, "BLOCK_BYTES", 8 * 4 * 3)
    monkeypatch.setattr(vectors, "HELD_BLOCKS", 2)
    rng = np.random.default_rng(1)
    pts = [(i, rng.normal(size=4).tolist(), "D", "S") for i in range(120)]
    qs = [(i, pts[i][1], None, None) for i in range(0, 120, 4)]
    plan = vectors.vector_search(spark.createDataFrame(qs, REQUESTS).repartition(2), spark.createDataFrame(pts, POINTS).repartition(3), 5)
    assert {q: [p for p, _ in h] for q, h in found_by(plan).items()} == {q: [p for p, _ in h] for q, h in brute_search(qs, pts, 5).items()}


def test_vector_search_of_nothing(spark):
    none, some = spark.createDataFrame([], REQUESTS), spark.createDataFrame([(1, [1.0], "D", "S")], POINTS)
    assert vectors.vector_search(none, some, 3).collect() == []
    assert vectors.vector_search(spark.createDataFrame([(1, [1.0], None, None)], REQUESTS), some.limit(0), 3).collect() == []


def test_rescore_equal_logits(spark):
    rows = [(1, i, 2.0) for i in range(3)] + [(2, i, float(i)) for i in range(3)]
    got = {(r.query_id, r.point_id): round(r.rerank_score, 4) for r in d.rescore(spark.createDataFrame(rows, "query_id long, point_id long, logit double"), 2).collect()}
    assert got == {(1, 0): 0.95, (1, 1): 0.95, (2, 2): 0.95, (2, 1): 0.725}


def test_embedding(spark):
    rows = d.embed(spark.createDataFrame([(i, f"word {i} word") for i in range(250)] + [(999, "")], "i int, t string"), "t").collect()
    for r in rows:
        assert len(r.vector) == d.DIM and np.allclose(r.vector, d.hashed_tokens([r.t])[0])


def test_replies(spark):
    rows = [(1, '{"entities": [{"entity_name": "VIBHU", "entity_type": "Person"}], "relationships": [{"source_entity": "Vibhu", "target_entity": "CP"}]}'),
            (2, 'x {"entities": [], "relationships": [{"source_entity": "A", "target_entity": "B", "relation": "R", "relationship_description": "d"} {"source_entity": "", "target_entity": "B"},]} y'), (3, "no json"), (4, '{"a" "b"}')]
    got = [tuple(r) for r in eg.parse_triplets(spark.createDataFrame(rows, "document_id long, reply string")).orderBy("document_id").collect()]
    assert got == [(1, 0, "Vibhu", "Person", "CP", "Entity", "RELATED", ""), (2, 0, "A", "Entity", "B", "Entity", "R", "d")]


def test_questions(spark):
    rows = [(1, "Does Pramila Das come under fraud?"), (2, 'Is "Pramila Das" flagged?'), (3, "Give details about Pramila Das"), (4, "check 599031892622"), (5, "does pramila das comes under fraud"), (6, "show all schems")]
    df = spark.createDataFrame(rows, "question_id long, question string")
    got = {r.question_id: r for r in q.classify(df).collect()}
    assert [got[i].person_name for i in (1, 2, 3)] == ["Pramila Das"] * 3 or got[1].person_name.endswith("Pramila Das")
    assert got[2].person_name == got[3].person_name == "Pramila Das" and got[5].person_name == "pramila das"
    assert got[4].uid_number == "599031892622" and got[1].is_fraud
    fixed = {r.question_id: r.normalized for r in q.normalise_questions(df).collect()}
    assert fixed[6] == "show all schemes" and fixed[4] == "check 599031892622"
    more = spark.createDataFrame([(1, "Schems, POLCY 12 eligibilty"), (2, ""), (3, "!!")], "question_id long, question string")
    assert {r.question_id: r.normalized for r in q.normalise_questions(more).collect()} == {1: "Schemes, POLICY 12 eligibility", 2: "", 3: "!!"}


def test_block_pairs_hold_few_scores(monkeypatch):
    rng = np.random.default_rng(4)
    q, p = rng.integers(-2, 3, (50, 4)).astype(float), rng.integers(-2, 3, (40, 4)).astype(float)
    schemes = [["A", "B", None][i % 3] for i in range(50)]
    row = {
        "block": [0], "q_ids": [list(range(50))], "q_vectors": [q.tobytes()], "q_docs": [[["d1"] if i % 7 == 0 else None for i in range(50)]], "q_schemes": [schemes],
        "p_ids": [list(range(40))], "p_vectors": [p.tobytes()], "p_docs": [[f"d{i % 3}" for i in range(40)]], "p_schemes": [["A" if i % 2 else "B" for i in range(40)]],
    }
    want = []
    for i in range(50):
        fits = [j for j in range(40) if (i % 7 or j % 3 == 1) and schemes[i] in (None, "A" if j % 2 else "B")]
        want += [(i, j, float(q[i] @ p[j])) for j in sorted(fits, key=lambda j: (-(q[i] @ p[j]), j))[:5]]
    sizes, masked = [], vectors.masked
    monkeypatch.setattr(vectors, "masked", lambda scores, *a: sizes.append(scores.size) or masked(scores, *a))
    for most in (1, 100, 1 << 20):
        monkeypatch.setattr(vectors, "SCORES", most)
        got = [r for b in vectors.pair_best(5)(iter([pa.RecordBatch.from_pydict(row)])) for r in zip(*(b.column(c).to_pylist() for c in range(3)))]
        assert sorted(got) == sorted(want) and max(sizes) <= max(most, 40)
        sizes.clear()
