"""Manifest, fill-in-the-middle and WARC archive: brute force, round trips, their SQL and edge cases."""

import hashlib
import random
import re
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from tessella.llm import fim, manifest, queries, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long, pos int, path string, grp int, digest string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, None if i == 3 else "en", s, None if i == 4 else 7, 1, "x", 2, "y") for i, t, s in rows], DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(3)
    some = lambda n: "".join(rng.choice(["ab", "C", " ", "é", "🙂", "\n", "<", ">", "1", "word"]) for _ in range(n))
    rows = [(i, some(rng.randint(0, 80)), "hot" if i % 3 else f"s{i % 4}") for i in range(900)]
    rows += [(1000, None, None), (1001, "", None), (1002, "<M>", "alone"), (1003, "a\n" * 30_000, ""), (1004, "x" * 50_000, ""), (1005, "same", "a"), (1005, "same", "a"), (1005, "other\n", "a"), (None, "no\nid", "a"), (None, "<P", "é")]
    return docs(spark, rows).cache()


def _h(nodes):
    return hashlib.sha256("".join(nodes).encode()).hexdigest()


def _tree(leaves, height=None):
    rows = [leaves]
    while len(rows[-1]) > 1 if height is None else len(rows) <= height:
        rows.append([_h(rows[-1][k : k + 3]) for k in range(0, len(rows[-1]), 3)])
    return rows


def _steps(rows, j):
    out = []
    for row in rows[:-1]:
        run = row[j // 3 * 3 : j // 3 * 3 + 3]
        out.append((j % 3, run[: j % 3] + run[j % 3 + 1 :]))
        j //= 3
    return out


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10, 28, 81, 82, 243, 244, 729])
@pytest.mark.parametrize("band", [1, 2, 4])
def test_traversal_by_whole_trees(n, band):
    leaves = [_h([str(k)]) for k in range(n)]
    for total in (n, 10**6):  # alone, or a block among others
        rows = _tree(leaves, manifest.levels(total))
        assert manifest.root(leaves, manifest.levels(total)) == rows[-1][0] and len(rows[-1]) == 1
        assert [list(s) for s in manifest.traverse(leaves, manifest.levels(total), band)] == [_steps(rows, j) for j in range(n)]


def test_subtrees_hold_few_nodes():
    leaves = [str(k) for k in range(3**6)]
    tree = manifest._Subtree(leaves, 4, 6, 0)
    while tree.grow():
        assert sum(map(len, tree.open)) <= 2 * 6 and sum(map(len, tree.kept)) <= 12


def _said(rows):
    return sorted(tuple(sorted((k, str(v)) for k, v in r.items())) for r in rows)


def _sql(name, **tables):
    con = duckdb.connect()
    for t, df in tables.items():
        con.register(t, df.toArrow())
    return con.execute(queries.ORACLE[name]).to_arrow_table().to_pylist()


@pytest.fixture
def saved(tmp_path):
    def save(**tables):
        for name, df in tables.items():
            df.write.parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return save


@pytest.mark.parametrize("height", [6, 1])
def test_manifest_by_whole_trees_and_sql(spark, odd, saved, monkeypatch, height):
    prove = manifest.prove
    monkeypatch.setattr(manifest, "prove", lambda df: prove(df, height))
    df = odd if height == 6 else odd.filter("doc_id < 60 or doc_id > 1000 or doc_id is null")
    got = [r.asDict() for r in queries.op11_manifest(spark, saved(documents=df)).collect()]
    leaf = lambda r, t: _h(["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r.doc_id, r.source, r.lang, r.n_chars, t)])
    groups = {}
    for r in df.collect():
        groups.setdefault(r.source, []).append((r.doc_id is not None, r.doc_id or 0, leaf(r, r.text), r))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: _tree([x[2] for x in sorted(groups[s], key=lambda x: x[:3])]) for s in names}
    over = _tree([trees[s][-1][0] for s in names])
    want = []
    for i, s in enumerate(names):
        for j, (_, _, own, r) in enumerate(sorted(groups[s], key=lambda x: x[:3])):
            steps = _steps(trees[s], j) + _steps(over, i)
            text = r.text.replace("\n", "") if r.text is not None and r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 2 == 0 else r.text
            at = leaf(r, text)
            for place, others in steps:
                at = _h([*others[:place], at, *others[place:]])
            proof = _h([x for _, others in steps for x in others])
            want.append({"doc_id": r.doc_id, "leaf": own, "subroot": trees[s][-1][0], "root": over[-1][0], "proof_sha256": proof, "folded_root": at, "verified": at == over[-1][0]})
    assert _said(got) == _said(want) == _said(_sql("op11_manifest", documents=df))
    assert {r["verified"] for r in got} == {True, False}
    assert manifest.prove(df.limit(0)).count() == 0
    one = manifest.prove(df.filter("doc_id = 1004")).first()
    assert one["path"] == [] and one["root"] == one["subroot"] == one["leaf"]


@pytest.mark.parametrize("piece", [1, 2, 7, 1024])
def test_ropes_by_plain_texts(piece):
    rng = random.Random(piece)
    for _ in range(400):
        text = "".join(rng.choice(["ab", "C", " ", "é", "🙂", "\n", "<", "1", "xyzzy" * rng.choice([1, 1, 90])]) for _ in range(rng.choice([0, 1, 3, 20, 90])))
        units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
        whole = fim.rope(text, piece)
        assert (whole.units, whole.chars, str(whole)) == (len(units), len(text), text)
        k, c = rng.randint(0, len(units)), rng.randint(0, len(text))
        a, b = fim.split_units(whole, k)
        assert (str(a), str(b), a.units, b.units) == ("".join(units[:k]), "".join(units[k:]), k, len(units) - k)
        a, b = fim.split_chars(whole, c)
        assert (str(a), str(b), a.chars) == (text[:c], text[c:], c)


def test_middles_by_sql_and_restored(spark, odd, saved):
    got = [r.asDict() for r in queries.op12_fim(spark, saved(documents=odd)).collect()]
    assert _said(got) == _said(_sql("op12_fim", documents=odd))
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}
    texts = {r["doc_id"]: r["text"] for r in odd.filter("doc_id < 1005").collect()}
    for r in fim.fill_in_middle(odd.filter("doc_id < 1005")).withColumn("back", fim.restored()).collect():
        assert r["back"] == (texts[r["doc_id"]] or "")
        if r["form"] == "psm":
            assert r["output"].startswith("<P>") and len(r["output"]) == len(r["back"]) + 9
    assert fim.fill_in_middle(odd.limit(0)).count() == 0


PAGES = "page_id long, url string, html string, bytes string, digest int, keeper int"
EVIL = "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n" * 60


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(1, "http://a", "x" * 1000), (2, "http://b\r\nX: y%", "x" * 1000), (3, None, "x" * 999), (4, "u", "x" * 999), (None, "u", "x" * 1000), (5, "u", None), (6, "u", ""), (7, "v", EVIL), (9, "v", EVIL), (9, "v", EVIL)]
    rows += [(None, "n", "é\r\n\r\n" * 500), (-3, "q", "q" * 1000), (-4, "q", "q" * 1000), (9, "w", "ß" * 500), (8, "w", "ß" * 500), (10, "long", "z" * 3_000_000)] + [(100 + k, f"h{k}", "hot" * 400) for k in range(40)] + [(200 + k, f"h{k}", "404") for k in range(40)]
    return spark.createDataFrame([(*r, "b", 1, 2) for r in rows], PAGES).cache()


@pytest.mark.parametrize("hot", [1000, 5])
def test_archive_by_sql_and_files(spark, pages, saved, monkeypatch, hot, tmp_path):
    monkeypatch.setattr(warc, "hot_from", lambda rows: hot)
    got = [r.asDict() for r in queries.op13_warc(spark, saved(pages=pages)).collect()]
    assert _said(got) == _said(_sql("op13_warc", pages=pages))
    held = warc.archive(pages)
    assert held.payloads.count() == pages.select(F.coalesce("html", F.lit(""))).distinct().count()
    records = {(r["page_id"], bytes(r["record"])) for r in warc.records(held).collect()}
    kinds = {r["page_id"]: r for r in got if r["page_id"] not in (None, 9)}
    for page_id, record in records:
        head, rest = record.split(b"\r\n\r\n", 1)
        length = int(re.search(rb"Content-Length: (\d+)", head)[1])
        assert head.startswith(b"WARC/1.1\r\n") and len(rest) == length + 4 and b"\nX: y" not in head
        if page_id in kinds and kinds[page_id]["record_type"] == "response":
            assert hashlib.sha1(rest[len(warc.HTTP) : length]).hexdigest() == kinds[page_id]["payload_digest"]
    warc.export(warc.records(held), f"{tmp_path}/files", 3)
    assert {bytes(r["record"]) for r in warc.import_files(spark, f"{tmp_path}/files").collect()} == {x for _, x in records}
    assert spark.sql("SHOW TABLES").filter("tableName like 'tessella_%'").isEmpty()
    assert warc.read_back(warc.archive(pages.limit(0))).count() == 0


def test_broken_records_stop_the_job(spark, pages):
    cut = warc.records(warc.archive(pages.filter("page_id = 1"))).withColumn("record", F.expr("substring(record, 1, 700)"))
    with pytest.raises(Exception, match="isn't as long as it says"):
        warc.parse(cut).collect()
