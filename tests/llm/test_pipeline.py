import re

import corpus_pipeline
from tests.llm import plain

SF = "/root/testdata/sf0.001"


def test_every_stage_against_a_plain_version(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, taken = docs.columns, {r.doc_id: r for r in docs.collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF).cache()
        left = {r.doc_id: r for r in out.collect()}
        if name == "quality_rules":
            measured = {i: plain.quality(r.text) for i, r in taken.items()}
            failed = {i for i, m in measured.items() if m[0] < 50 or 100 * m[4] > 50 * m[0]}
            assert not failed & left.keys()
            good = [i for i in taken if labels.get(i) == 1 and i not in failed]
            assert sum(i in left for i in good) >= 0.99 * len(good) and all(left[i] == taken[i] for i in left)
        elif name == "near_duplicates":
            root = plain.alike([(i, r.text) for i, r in taken.items()], 5, 80)
            assert left.keys() == {i for i in taken if root[i] == i}
        elif name == "repeated_passages":
            want = plain.kept_words(sorted((i, r.text) for i, r in taken.items()))
            assert all(plain.words(left[i].text) == [w for w, k in zip(*want[i]) if k] for i in taken) and left.keys() == taken.keys()
        elif name == "secret_scan":
            for i, r in taken.items():
                text = list(r.text)
                for a, _, b, _ in plain.secrets(r.text):
                    text[a:b] = "*" * (b - a)
                assert re.sub(r"\*", "", left[i].text) == re.sub(r"\*", "", "".join(text))
        else:
            coder, total = plain.encoding(), {}
            for r in out.collect():
                total[r.doc_id] = total.get(r.doc_id, 0) + r.length
            assert total == {i: len(coder.encode_ordinary(r.text)) + 1 for i, r in taken.items()}
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == columns
        docs, taken = out, left
