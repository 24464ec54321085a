"""The whole pipeline against plain Python, stage after stage, on a small folder of tables."""

import math

import corpus_pipeline
import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
from test_decontamination import slow
from test_repeats import slow_words
from test_simhash import slow_groups
from tokenizers import Tokenizer

from tracewright.llm.toxicity import Settings, fitted, subwords

DATA = "/root/testdata/sf0.001"


def slow_score(text, weights, s):
    words = list(dict.fromkeys((text or "").lower().split())) or [""]
    best = -math.inf
    for i in range(0, len(words), s.stretch):
        _, bucket = subwords(words[i : i + s.stretch], s)
        best = max(best, weights[bucket].sum() / (len(bucket) + s.neutral) + weights[-1])
    return 1 / (1 + math.exp(-best))


def tables(folder):
    docs = pq.read_table(f"{DATA}/documents.parquet")
    labels = pq.read_table(f"{DATA}/labels.parquet").to_pylist()
    benchmark = pq.read_table(f"{DATA}/benchmark.parquet")
    toxic = {r["doc_id"] for r in labels if r["toxic"] == 1}
    rows = [r for r in docs.to_pylist() if len(r["text"] or "") < 8000]
    rows = [r for r in rows if r["doc_id"] in toxic][:40] + [r for r in rows if r["doc_id"] not in toxic][:110]
    clean = [r for r in rows if r["doc_id"] not in toxic and len(r["text"] or "") > 600]
    item = max((r["text"] or "" for r in benchmark.to_pylist()), key=len)
    passage = " ".join(f"passage{i}" for i in range(60))
    top = max(r["doc_id"] for r in rows)
    texts = [clean[0]["text"], clean[0]["text"], clean[1]["text"] + " end", None, ""]
    texts += [clean[2]["text"][:300] + " " + item, clean[3]["text"][:400] + " " + passage, passage + " " + clean[4]["text"][:400]]
    rows += [clean[0] | {"doc_id": top + 1 + k, "text": t} for k, t in enumerate(texts)]
    pq.write_table(pa.Table.from_pylist(rows, docs.schema), f"{folder}/documents.parquet")
    pq.write_table(pa.Table.from_pylist(labels), f"{folder}/labels.parquet")
    pq.write_table(benchmark, f"{folder}/benchmark.parquet")
    return rows, [(r["item_id"], r["text"]) for r in benchmark.to_pylist()]


def test_run(spark, tmp_path):
    rows, items = tables(tmp_path)
    docs, labels = (spark.read.parquet(f"{tmp_path}/{n}.parquet") for n in ("documents", "labels"))
    s = Settings()
    weights = fitted(docs, labels, s).astype(np.float32).astype(np.float64)
    kept = [(r["doc_id"], r["text"]) for r in rows]
    sizes = [len(kept)]
    kept = [(i, t) for i, t in kept if not (t or "").strip(" ") or slow_score(t, weights, s) < 0.5]
    sizes.append(len(kept))
    first = {i for i, _, c in slow_groups(kept) if i == c}
    kept = [(i, t) for i, t in kept if i in first]
    sizes.append(len(kept))
    cut = slow_words(kept, 35)
    assert any(n for _, _, n, _ in cut)
    kept = [(i, t) for i, _, _, t in cut]
    leaks = {d for d, *_ in slow(kept, items)}
    kept = [(i, t) for i, t in kept if i not in leaks]
    sizes.append(len(kept))
    assert sizes == sorted(set(sizes), reverse=True)  # every filter drops something

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {i: np.array([*library.encode(t, add_special_tokens=False).ids, 1], "<u4").tobytes() for i, t in kept}
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    got, windows = {}, {}
    for p in sorted(pieces, key=lambda p: (p.doc_id, p.start)):
        got[p.doc_id] = got.get(p.doc_id, b"") + bytes(p.ids)
        windows.setdefault(p.sequence_id, []).append((p.offset, p.length))
    assert got == want
    for w in windows.values():
        w.sort()
        assert [o for o, _ in w] == [sum(n for _, n in w[:k]) for k in range(len(w))] and sum(n for _, n in w) <= 2048
