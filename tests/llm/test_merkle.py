import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from scorewatch.llm import merkle


def h(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf_of(row, text):
    values = [row["doc_id"], row["source"], row["lang"], row["n_chars"], text]
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def lower(t):
    return t and "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def levels_of(nodes, fan):
    levels = [nodes]
    while len(levels[-1]) > 1:
        now = levels[-1]
        levels.append([h("".join(now[i:i + fan])) for i in range(0, len(now), fan)])
    return levels


def siblings(levels, pos, fan):
    out = []
    for now in levels[:-1]:
        lo = pos // fan * fan
        run = now[lo:lo + fan]
        out.append(("".join(run[:pos - lo]), "".join(run[pos - lo + 1:])))
        pos //= fan
    return out


def brute(rows, fan=8):
    trees = {}
    for r in rows:
        trees.setdefault(r["lang"], []).append((r["doc_id"] is not None, r["doc_id"] or 0, leaf_of(r, r["text"]), r))
    names = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    low = {}
    for x in names:
        trees[x].sort(key=lambda t: t[:3])
        low[x] = levels_of([t[2] for t in trees[x]], fan)
    top = levels_of([low[x][-1][0] for x in names], fan)
    root = top[-1][0]
    out = []
    for i, x in enumerate(names):
        for pos, (_, _, leaf, r) in enumerate(trees[x]):
            path = siblings(low[x], pos, fan) + siblings(top, i, fan)
            crc = None if r["doc_id"] is None else zlib.crc32(str(r["doc_id"]).encode())
            node = leaf_of(r, lower(r["text"])) if crc is not None and crc % 3 == 0 else leaf
            for a, b in path:
                node = h(a + node + b)
            out.append((str(r["doc_id"]), leaf, low[x][-1][0], root, h("".join(a + b for a, b in path)), node, node == root))
    return sorted(out)


def made(n, langs):
    rows = []
    for i in range(n):
        text = None if i % 11 == 5 else "" if i % 13 == 0 else f"Text Nr {i} é\n" * (1 + i % 4)
        rows.append({"doc_id": None if i % 41 == 7 else i * 37 % 1009, "source": None if i % 9 == 0 else f"s{i % 3}",
                     "lang": langs(i), "n_chars": None if i % 7 == 0 else i, "text": text})
    return rows + rows[:3]                                    # repeated rows


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"
LANGS = {"one": lambda i: "en", "hot": lambda i: None if i % 50 == 1 else "en" if i % 3 else f"x{i % 5}",
         "lone": lambda i: f"l{i}", "bytes": lambda i: ["é", "z", "", "ﬀ", "𝒳", "-"][i % 6]}


def answer(spark, tmp_path, rows):
    path = str(tmp_path)
    spark.createDataFrame([tuple(r.values()) for r in rows], SCHEMA).repartition(5).withColumns(
        {"POS": F.lit(1), "tree": F.lit("t"), "block": F.lit(2), "path": F.lit("p"), "leaf": F.lit("l")}
    ).write.parquet(f"{path}/documents.parquet")
    got = merkle.op13_merkle_manifest(spark, path)
    return sorted((str(r["doc_id"]), *r[1:]) for r in got.collect())


@pytest.mark.parametrize("langs", LANGS)
def test_against_brute_force(spark, tmp_path, langs):
    rows = made(150, LANGS[langs])
    assert answer(spark, tmp_path, rows) == brute(rows)


@pytest.mark.parametrize("n", [1, 8, 9, 65])
def test_heights(spark, tmp_path, n):
    rows = [dict(r, doc_id=i) for i, r in enumerate(made(80, LANGS["one"])[:n])]
    rows[0]["text"] = "Long " * 100_000
    assert answer(spark, tmp_path, rows) == brute(rows)


def test_other_fans(spark):
    rows = made(40, LANGS["hot"])
    docs = spark.createDataFrame([tuple(r.values()) for r in rows], SCHEMA)
    got = merkle.manifest(docs, fan=2).select(merkle.proof_digest(F.col("proof")).alias("p"), "root").collect()
    assert sorted(r["p"] for r in got) == sorted(x[4] for x in brute(rows, fan=2))


def test_no_rows(spark):
    assert merkle.manifest(spark.createDataFrame([], SCHEMA)).collect() == []
