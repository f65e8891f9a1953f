"""The pipeline, stage by stage, against plain Python over the rows each stage was given."""

import os
import zlib
from collections import defaultdict

import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from plotyard.llm.tokens import default_tokenizer
from tests.llm.test_decontaminate import brute as contaminated
from tests.llm.test_line_dedup import distance
from tests.llm.test_shingle_join import brute as near

SF_DIR = os.environ.get("PLOTYARD_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="driver tables are not here")


def without_lines(rows):
    """Per document text without the lines that repeat earlier ones, exactly or within one edit for every ten code points, two at most."""
    lines = sorted({x for r in rows for x in r.text.split("\n") if x.strip()}, key=len)
    label = {x: x for x in lines}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, a in enumerate(lines):
        edits = min(2, len(a) // 10)
        part = len(a) // (edits + 1)  # within so many edits one part survives
        for b in lines[i + 1 :] if edits else ():
            if len(b) - len(a) > edits:
                break
            if any(a[k * part : (k + 1) * part] in b for k in range(edits + 1)) and distance(a, b) <= edits:
                label[root(a)] = root(b)
    seen, out = set(), {}
    for r in sorted(rows, key=lambda r: r.doc_id):
        kept = []
        for x in r.text.split("\n"):
            if x.strip():
                if root(x) in seen:
                    continue
                seen.add(root(x))
            kept.append(x)
        if "\n".join(kept) == r.text or "".join(kept).strip():
            out[r.doc_id] = "\n".join(kept)
    return out


def test_stages_match_plain_python(spark, tmp_path):
    def reread(docs):
        path = str(tmp_path / f"{len(list(tmp_path.iterdir()))}.parquet")
        docs.write.parquet(path)
        return spark.read.parquet(path)

    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
    columns, given = docs.columns, {r.doc_id: r for r in docs.collect()}
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality classifier", "line dedup", "n-gram Jaccard join", "benchmark decontamination", "packing"]

    kept = reread(stages["quality classifier"](spark, docs, SF_DIR))
    rows = kept.collect()
    assert kept.columns == columns and all(given[r.doc_id] == r for r in rows) and len(rows) > 0.8 * len(given)

    lined = reread(stages["line dedup"](spark, kept, SF_DIR))
    assert lined.columns == columns
    assert {r.doc_id: r.text for r in lined.collect()} == without_lines(rows)
    assert all(r.n_chars == len(r.text) for r in lined.collect())

    single = reread(stages["n-gram Jaccard join"](spark, lined, SF_DIR))
    before = [(r.doc_id, r.text) for r in lined.collect()]
    assert single.columns == columns
    assert {r.doc_id for r in single.collect()} == {c for _, c, _ in near(before)}

    clean = reread(stages["benchmark decontamination"](spark, single, SF_DIR))
    judged = contaminated([(r.doc_id, r.text) for r in single.collect()], items)
    assert clean.columns == columns and {r.doc_id for r in clean.collect()} == {d for d, *_, bad in judged if not bad}

    whole = Tokenizer.from_file(default_tokenizer())
    pieces = defaultdict(list)
    for r in stages["packing"](spark, clean, SF_DIR).collect():
        pieces[r.doc_id].append(r)
    texts = {r.doc_id: r.text for r in clean.collect()}
    assert set(pieces) == set(texts)
    for doc_id, parts in pieces.items():
        ids = b"".join(bytes(p.ids) for p in sorted(parts, key=lambda p: p.start))
        want = [*whole.encode(texts[doc_id], add_special_tokens=False).ids, 2]
        assert ids == b"".join(i.to_bytes(4, "little") for i in want)
        assert all(zlib.crc32(bytes(p.ids)) == p.ids_crc32 for p in parts)


def test_run_gives_the_pieces_of_the_last_stage(spark):
    got = corpus_pipeline.run(spark, SF_DIR)
    assert {"doc_id", "start", "length", "sequence_id", "offset", "ids"} <= set(got.columns) and got.count() > 100
