"""Every pipeline stage's rows against plain Python, with null and repeated ids among them."""

from collections import Counter

import corpus_pipeline
from test_brute import SF, WORD, brute_components, shingle_set

from patchweave.llm import mixing, quality_classifier, secret_scans


def kept(rows):
    """(least id, component) of every component of similar texts, and the rows without id."""
    named = [r for r in rows if r.doc_id is not None]
    sets = {i: shingle_set(r.text or "") for i, r in enumerate(named)}
    of, best, by_text = brute_components(sets), {}, {}
    for i, r in enumerate(named):
        c = by_text[r.doc_id, r.text] = of[i] if sets[i] else ("empty", r.doc_id)
        best[c] = min(best.get(c, r.doc_id), r.doc_id)
    return Counter((i, c) for c, i in best.items()), by_text


def mask(text, spans):
    out, at = "", 0
    for a, b in sorted(spans):
        if a >= at:
            out += text[at:a] + "[SECRET]"
        at = max(at, b)
    return out + text[at:]


def test_stages(spark, tmp_path):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = docs.orderBy("doc_id").collect()
    add = [{**r.asDict(), "doc_id": None} for r in rows[:30]] + [{**r.asDict(), "doc_id": rows[-1 - k].doc_id} for k, r in enumerate(rows[30:60])] + [r.asDict() for r in rows[60:80]]
    now = spark.createDataFrame([*(tuple(r) for r in rows), *(tuple(a[c] for c in docs.columns) for a in add)], docs.schema)
    for name, step in corpus_pipeline.STAGES:
        step(spark, now, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        then = spark.read.parquet(f"{tmp_path}/{name}")
        before, after = now.collect(), then.collect()
        assert after, name
        if name == "quality":
            want = Counter(r.doc_id for r in quality_classifier.classify(now, labels).collect() if r.predicted)
            assert Counter(r.doc_id for r in after) == want
        elif name == "near_duplicates":
            want, component = kept(before)
            assert Counter((r.doc_id, component[r.doc_id, r.text]) for r in after if r.doc_id is not None) == want
            assert Counter(r for r in after if r.doc_id is None) == Counter(r for r in before if r.doc_id is None)
        elif name == "secrets":
            found = secret_scans.scan(now, ["doc_id", "text"]).collect()
            assert Counter((r.doc_id, r.text) for r in after) == Counter((r.doc_id, r.text and mask(r.text, [(s["at"], s["end"]) for s in r.base + r.linked])) for r in found)
        elif name == "mixing":
            want, got = Counter(), Counter((r.source, r.doc_id, len(WORD.findall(r.text or ""))) for r in after)
            for r in mixing.mix(now).collect():
                want[r.source, r.doc_id, r.size] += r.copies
            assert got == +want and set(after) <= set(before)
        else:
            assert Counter(r.doc_id for r in after if r.start == 0) == Counter(r.doc_id for r in before)
        now = then
