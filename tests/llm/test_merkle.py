"""The manifest against a plain tree, and its proofs."""

import hashlib
import zlib

import pytest

from checks.compare import connect, difference
from vigilframe.llm import merkle
from vigilframe.llm.oracle import ORACLE
from vigilframe.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, leaf string, root int, key string"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row, text):
    values = (row[0], row[3], row[2], row[4], text)
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(nodes):
    found = [nodes]
    while len(found[-1]) > 1:
        found.append([H(*found[-1][i : i + 8]) for i in range(0, len(found[-1]), 8)])
    return found


def way(levels, at):
    for nodes in levels[:-1]:
        start = at // 8 * 8
        yield at - start, nodes[start : start + 8]
        at //= 8


def brute(rows):
    groups = {}
    for r in rows:
        lowered = r[1] and "".join(c.lower() if "A" <= c <= "Z" else c for c in r[1])
        changed = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
        groups.setdefault(r[2], []).append((r[0], leaf_of(r, r[1]), leaf_of(r, lowered) if changed else leaf_of(r, r[1])))
    names = sorted(groups, key=lambda g: b"" if g is None else b"v" + g.encode())
    trees = {}
    for g in names:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        trees[g] = tree([leaf for _, leaf, _ in groups[g]])
    top = tree([trees[g][-1][0] for g in names])
    out = []
    for at, g in enumerate(names):
        for i, (doc_id, leaf, shown) in enumerate(groups[g]):
            proof, node = [], shown
            for own, run in (*way(trees[g], i), *way(top, at)):
                proof += run[:own] + run[own + 1 :]
                node = H(*run[:own], node, *run[own + 1 :])
            root = top[-1][0]
            out.append((doc_id, leaf, trees[g][-1][0], root, H(*proof), node, node == root))
    return sorted(out, key=repr)


def made(n=9000):
    """A group of more than two rounds' arrays, small ones, ids that many rows have, rows without id."""
    rows = [(i * 7 - 3000, f"Text {i}" if i % 5 else "", "en", f"s{i % 3}", i) for i in range(n)]
    rows += [(i, "Same id", "de", f"s{i}", 1) for i in (5, 5, 5, 70, 70) for _ in range(4)]
    rows += [(None, f"T{i % 20}", "de", "s", None) for i in range(60)]
    rows += [(1 << 62, "far", "fr", "s", 3), (-(1 << 62), None, "fr", None, None), (3, "A" * 100_000, None, "s", 2)]
    rows += [(4, "equal ROWS", "equal", "s", 2)] * 5000 + [(i, f"L{i}", f"l{i}é", "s", 1) for i in range(40)]
    rows += [(6, "lone", "", "s", 1)]
    return rows


@pytest.mark.parametrize("rows", [made(), made(8)[:8], made()[:1], made(64)[:65]], ids=["many", "run", "one", "more"])
def test_against_a_plain_tree(spark, rows):
    docs = spark.createDataFrame([(*r, "x", 1, "k") for r in rows], SCHEMA)
    found = merkle.verified(docs)
    assert found.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(tuple, found.collect()), key=repr) == brute(rows)


def test_more_groups_than_an_array_holds(spark):
    rows = [(i, f"Text {i}", f"lang{i % 4500}", "s", 1) for i in range(6000)]
    found = merkle.verified(spark.createDataFrame([(*r, "x", 1, "k") for r in rows], SCHEMA))
    assert sorted(map(tuple, found.collect()), key=repr) == brute(rows)


def test_proofs_and_places(spark):
    rows = made(100)
    docs = spark.createDataFrame([(*r, "x", 1, "k") for r in rows], SCHEMA)
    places = {}
    for r in merkle.manifest(docs).collect():
        assert r.folded_root == r.root
        node = r.leaf
        for own, rest in zip(r.slots, r.proof):
            node = H(rest[: 64 * own], node, rest[64 * own :])
        assert node == r.root
        places.setdefault(r.group_key, []).append(r.position)
    assert all(sorted(p) == list(range(len(p))) for p in places.values())


def test_no_rows(spark):
    assert merkle.verified(spark.createDataFrame([], SCHEMA)).collect() == []


def test_query(spark):
    assert difference(QUERIES["op11_merkle"](spark, SF), connect(SF), ORACLE["op11_merkle"]) is None


def test_query_by_brute_force(spark):
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select(columns).collect()]
    assert sorted(map(tuple, QUERIES["op11_merkle"](spark, SF).collect()), key=repr) == brute(rows)
