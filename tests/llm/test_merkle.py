import hashlib
import zlib

import pytest

from plotyard.llm import merkle
from plotyard.llm.merkle import append_log, build_manifest, fold, height_of, log_nodes, log_position, log_size, manifest_proofs, parent, prove, siblings_of
from plotyard.llm.queries import QUERIES

SCHEMA = "number string, text string, doc_id long, tree string, source string, n_chars int, lang string, claim string"
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(values):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def levels(nodes):
    """Levels of a tree from the leaves to the root, as hex texts."""
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][i : i + 16])) for i in range(0, len(out[-1]), 16)])
    return out


def siblings(tree, i):
    for level in tree[:-1]:
        run = i // 16 * 16
        yield i % 16, [x for k, x in enumerate(level[run : run + 16]) if run + k != i]
        i //= 16


def brute(docs, altered):
    trees = {}
    for d in docs:
        values = [d[f] for f in FIELDS]
        trees.setdefault(d["source"], []).append((values, leaf(values), leaf([altered(d) if f == "text" else d[f] for f in FIELDS])))
    names = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    built = {}
    for s in names:
        trees[s].sort(key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1]))
        built[s] = levels([x[1] for x in trees[s]])
    top = levels([built[s][-1][0] for s in names])
    rows = []
    for k, s in enumerate(names):
        for i, (values, own, claim) in enumerate(trees[s]):
            steps = [*siblings(built[s], i), *siblings(top, k)]
            node = claim
            for place, others in steps:
                node = sha("".join([*others[:place], node, *others[place:]]))
            rows.append((values[0], own, built[s][-1][0], top[-1][0], sha("".join(x for _, o in steps for x in o)), node, node == top[-1][0]))
    return sorted(rows, key=str)


def lowered(d):
    tampered = d["doc_id"] is not None and zlib.crc32(str(d["doc_id"]).encode()) % 5 == 0
    return d["text"] and "".join(c.lower() if tampered and "A" <= c <= "Z" else c for c in d["text"])


def read(rows):
    return sorted(((r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in rows), key=str)


def test_closed_form_positions_are_those_of_the_append_log():
    for n in [*range(1, 40), 255, 256, 257, 272, 273, 300, 4095, 4096, 4097, 5000]:
        leaves = [i.to_bytes(32, "big") for i in range(n)]
        height = height_of(n)
        log = append_log(leaves, height)
        assert len(log) == log_size(n)
        level, seen = leaves, set()
        for k in range(height + 1):
            for i, node in enumerate(level):
                at = log_position(k, i, n)
                assert log[at] == node
                seen.add(at)
            level = [parent(level[i : i + 16]) for i in range(0, len(level), 16)]
        assert seen == set(range(len(log)))


def test_a_builder_of_a_taller_tree_closes_at_its_height():
    log = append_log([bytes(32)], 3)
    assert len(log) == log_size(1, 3) == 4 and [log_position(k, 0, 1, 3) for k in range(4)] == [0, 1, 2, 3]
    assert log[3] == parent([parent([parent([bytes(32)])])])


@pytest.fixture(scope="module")
def odd():
    docs = [{"doc_id": i, "source": f"s{i % 7}" if i % 3 else "hot", "lang": "en", "n_chars": i, "text": f"Text {i} ÄÖ Ü"} for i in range(900)]
    docs += [dict(docs[5])] * 30 + [dict(docs[6], text="Other")]  # repeated rows; one id with two texts
    docs += [{"doc_id": None, "source": None, "lang": None, "n_chars": None, "text": None}] * 2
    docs += [{"doc_id": 950, "source": None, "lang": "", "n_chars": -1, "text": ""}, {"doc_id": 951, "source": "", "lang": "x", "n_chars": 0, "text": "A" * 50_000}]
    docs += [{"doc_id": 952, "source": "ü", "lang": "x", "n_chars": 0, "text": "-"}, {"doc_id": -7, "source": "z", "lang": "x", "n_chars": 0, "text": "7:"}]
    return docs


def frame(spark, docs):
    return spark.createDataFrame([("x", d["text"], d["doc_id"], "clash", d["source"], d["n_chars"], d["lang"], "y") for d in docs], SCHEMA).repartition(6)


def test_odd_rows_match_brute_force_over_several_bands(spark, odd):
    from plotyard.llm.queries import tampered

    want = brute(odd, lowered)
    assert read(manifest_proofs(frame(spark, odd), tampered).collect()) == want
    assert read(manifest_proofs(frame(spark, odd), tampered, band=1).collect()) == want  # three bands of builders


def test_bands_together_are_one_log(spark):
    docs = [{"doc_id": i, "source": "a", "lang": "en", "n_chars": 1, "text": str(i)} for i in range(700)]
    manifest = build_manifest(frame(spark, docs), band=1)
    found = {}
    for band in range(len(manifest.sources)):
        for r in log_nodes(manifest, band).collect():
            assert r.position not in found
            found[r.position] = bytes(r.digest)
    leaves = [bytes.fromhex(leaf([d[f] for f in FIELDS])) for d in docs]
    assert [found[i] for i in range(len(found))] == append_log(leaves, height_of(700))
    claims = manifest.rows.filter("rank = 699").select("tree", "rank", "doc_id", "digest").withColumnRenamed("digest", "claim")
    assert [r.folded_root for r in prove(manifest, claims).collect()] == [manifest.root.hex()]


def test_paths_name_places_and_siblings():
    stretch = merkle.Stretch(b"".join(append_log([bytes([i]) * 32 for i in range(18)], 2)), 18, 2)
    steps = list(siblings_of(stretch.path(17)))
    assert [(place, len(s)) for place, s in steps] == [(1, 1), (1, 1)]
    assert fold(bytes([17]) * 32, stretch.path(17)) == stretch.node(2, 0)


def test_one_row_and_no_rows(spark):
    one = {"doc_id": 1, "source": None, "lang": None, "n_chars": 3, "text": "abc"}
    assert read(manifest_proofs(frame(spark, [one])).collect()) == brute([one], lambda d: d["text"])
    assert manifest_proofs(frame(spark, [])).collect() == []


def test_query_matches_brute_force(spark):
    docs = [r.asDict() for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    found = read(QUERIES["op13_merkle_manifest"](spark, "/root/testdata/sf0.01").collect())
    assert found == brute(docs, lowered)
    assert 0 < sum(not r[-1] for r in found) < len(found)
