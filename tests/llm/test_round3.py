"""Hard negatives, conversation repair and WARC archives: against SQL or brute force, and their edge cases."""

import math

import duckdb
import pandas as pd
import pytest

from compare import connect, difference
from promptscore.llm import hard_negatives, sql

SF = "/root/testdata/sf0.01"


def test_hard_negatives_in_many_blocks_and_chunks_equal_sql(spark):
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet")
    found = hard_negatives.hard_negatives(spark, vectors, chunk_anchors=2, block_rows=64)
    assert found.count() > 0
    assert difference(found, connect(SF), sql.OP11) is None


EDGE_VECTORS = [
    (0, [1.0, 0.5, 0.25], 1, "x"),
    (100, [1.0, 0.5], 1, "x"),  # shorter: padded with zeros
    (1, [1.0, 0.5, 0.2], 1, None),
    (2, [0.9, 0.5, 0.2], 1, None),
    (3, [0.9, 0.4, 0.2], 2, None),
    (4, [0.8, 0.4, 0.2], 3, None),
    (5, [0.8, 0.4, 0.2], 3, None),  # tie of scores: smaller id first
    (8, [0.8, 0.4, 0.2], 3, None),
    (6, [float("nan"), 0.0, 0.0], 2, None),
    (9, [float("inf"), 0.0, 0.0], 2, None),
    (10, [None, 0.0, 0.0], 2, None),
    (11, None, 2, None),
    (12, [0.9, 0.4, 0.2], None, None),
    (None, [0.9, 0.4, 0.2], 2, None),
    (13, [], 3, None),  # empty: scores 0
    (14, [0.9, 0.4, 0.2], 7, None),  # 14 is divisible by 7: label 8
    (14, [0.9, 0.4, 0.2], 7, None),  # repeated row
    (200, [0.0, 0.0, 0.0], 1, None),  # a zero anchor
    (201, [0.0, 0.0, 0.0], 2, None),
]


def _edge_table(spark):
    rows = [(i, v, l, e, "clash") for i, v, l, e in EDGE_VECTORS]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, extra string, v string")


def test_hard_negatives_edge_cases_equal_sql(spark):
    table = _edge_table(spark)
    db = duckdb.connect()
    db.register("edge", table.toPandas())
    db.execute("CREATE VIEW embeddings AS SELECT * FROM edge")
    for chunk, block in ((4096, 16384), (1, 2)):
        found = hard_negatives.hard_negatives(spark, table, chunk_anchors=chunk, block_rows=block)
        assert difference(found, db, sql.OP11) is None
    rows = {(r.anchor_id, r.positive_id, r.negative_id) for r in found.collect()}
    assert all(6 not in r and 9 not in r and 10 not in r and 11 not in r for r in rows)


def test_hard_negatives_empty_and_anchorless(spark):
    table = _edge_table(spark)
    assert hard_negatives.hard_negatives(spark, table.limit(0)).count() == 0
    assert hard_negatives.hard_negatives(spark, table.where("vec_id % 100 <> 0")).count() == 0


def test_hard_negatives_walks_stop_early_but_not_wrongly():
    import numpy as np

    rng = np.random.default_rng(3)
    base = rng.normal(size=(1, 16))
    rows = pd.DataFrame(
        {
            "vec_id": np.arange(3000),
            "label": rng.integers(0, 3, 3000),
            "v": list(np.floor(256 * (base + 0.3 * rng.normal(size=(3000, 16)))).astype(np.int64)),
        }
    )
    anchors = rows[rows.vec_id % 100 == 0].reset_index(drop=True)
    got = hard_negatives._positives(anchors, rows)
    v = np.stack(rows.v)
    for a in anchors.itertuples():
        scores = v @ np.asarray(a.v)
        same = rows[(rows.label == a.label) & (rows.vec_id != a.vec_id)].assign(s=scores[(rows.label == a.label) & (rows.vec_id != a.vec_id)])
        want = same.sort_values(["s", "vec_id"], ascending=[False, True]).head(5)
        mine = got[got.anchor_id == a.vec_id]
        assert list(mine.vec_id) == list(want.vec_id) and list(mine.score) == list(want.s)


# conversation repair ---------------------------------------------------------------------------------

import hashlib  # noqa: E402
import itertools  # noqa: E402
import random  # noqa: E402
import re  # noqa: E402
import zlib  # noqa: E402

from promptscore.llm import conversation_repair as cr  # noqa: E402

SHAPE = re.compile(r"(s?(ua)+)?")


def brute_repair(roles, texts):
    """(cost, audit, repaired text) by trying every edit sequence; at most two inserts in a gap suffice."""
    fault = cr.faults(roles, texts)
    row_choices = []
    for i, f in enumerate(fault):
        options = [("D", None, 2)]
        if f not in (1, 2):
            extra = 5 if f == 3 else 0
            options += [("K", roles[i], extra), ("R", "user", 1 + extra), ("R", "assistant", 1 + extra)]
        row_choices.append(options)
    gap_choices = [()] + [(r,) for r in ("user", "assistant")] + list(itertools.product(("user", "assistant"), repeat=2))
    best = None
    for rows in itertools.product(*row_choices):
        for gaps in itertools.product(gap_choices, repeat=len(roles) + 1):
            audit, out, cost = "", [], 0
            for i in range(len(roles) + 1):
                for role in gaps[i]:
                    audit, cost = audit + "I", cost + 5
                    out.append((role, ""))
                if i < len(roles):
                    code, role, c = rows[i]
                    audit, cost = audit + code, cost + c
                    if code != "D":
                        out.append((role, texts[i]))
            if not SHAPE.fullmatch("".join(r[:1] or "#" for r, _ in out)):  # an empty role fits nowhere
                continue
            text = "\n".join(f"{r}:{t}" for r, t in out)
            key = (cost, audit)
            if best is None or key < best[0]:
                best = (key, {text})
            elif key == best[0]:
                best[1].add(text)
    (cost, audit), repaired = best
    assert len(repaired) == 1
    return cost, audit, repaired.pop()


def test_repair_path_equals_brute_force():
    rng = random.Random(7)
    roles_pool = ["user", "assistant", "system", "tool", " ", "u", ""]
    texts_pool = ["Hi.", "Hi", "", " ", "ok!", "Why?", "x\n"]
    for _ in range(250):
        n = rng.randint(0, 3)
        roles = [rng.choice(roles_pool) for _ in range(n)]
        texts = [rng.choice(texts_pool) for _ in range(n)]
        cost, audit, repaired = brute_repair(roles, texts)
        mine = cr.repair_path([r[:1] for r in roles], cr.faults(roles, texts)) if n else (0, "", [])
        assert (mine[0], mine[1]) == (cost, audit), (roles, texts)


def _python_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        fate = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if fate == 0:
            continue
        if fate == 1:
            text = ""
        if fate == 2:
            text = re.sub("[.!?]", "", text)
        if fate == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (2 if fate == 3 else 1)
    return out


def test_conversation_repair_on_edge_rows_equals_brute_force(spark):
    rng = random.Random(11)
    rows = []
    for conv in [None, 1, 2, 3, 4, 5, 6, 7, 8, 9]:
        for turn in range(rng.randint(1, 3)):
            role = rng.choice(["user", "assistant", "system", None, "tool"])
            text = rng.choice(["Hello there.", "no end", None, "", "Again!", "Hello there."])
            rows.append((conv, rng.choice([turn, turn, None]), role, text))
    rows.append(rows[-1])  # a repeated row
    table = spark.createDataFrame([(*r, "x", 0) for r in rows], "conv_id long, turn long, role string, text string, audit string, present int")
    got = {r.conv_id: r for r in cr.repaired(table).collect()}
    assert set(got) == {r[0] for r in rows}
    after = _python_damage(rows)
    for conv in got:
        mine = sorted([r for r in after if r[0] == conv], key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        roles, texts = [r[2] for r in mine], [r[3] for r in mine]
        cost, audit, repaired = brute_repair(roles, texts) if len(mine) <= 3 else (None, None, None)
        fault = cr.faults(roles, texts)
        assert (got[conv].blank, got[conv].duplicate, got[conv].truncated) == (fault.count(1), fault.count(2), fault.count(3))
        if cost is not None:
            assert (got[conv].cost, got[conv].audit) == (cost, audit)
            assert got[conv].repaired_sha256 == hashlib.sha256(repaired.encode()).hexdigest()


def test_conversation_repair_empty_and_all_dropped(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert cr.repaired(spark.createDataFrame([], schema)).count() == 0
    dropped = [c for c in range(2000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0][0]
    row = cr.repaired(spark.createDataFrame([(dropped, 0, "user", "Hi.")], schema)).collect()[0]
    assert (row.cost, row.gaps, row.audit, row.blank) == (0, 0, "", 0)
    assert row.repaired_sha256 == hashlib.sha256(b"").hexdigest()


# WARC ------------------------------------------------------------------------------------------------

from promptscore import new_work_dir  # noqa: E402
from promptscore.llm import warc  # noqa: E402

PAGES = [
    (1, "http://a/1", "<p>same</p>", "x"),
    (2, "http://a/2", "<p>same</p>", "x"),
    (3, None, None, "x"),
    (4, "http://a/\n4", "", "x"),
    (None, "http://a/5", "<p>same</p>", "x"),
    (None, "http://a/6", "<b>alone</b>", "x"),
    (7, "http://a/7", "é" * 50_000, "x"),
    (7, "http://a/7", "é" * 50_000, "x"),  # a repeated row
    (8, "http://a/8", "<p>other</p>", "x"),
]


def _pages(spark):
    return spark.createDataFrame(PAGES, "page_id long, url string, html string, payload string")


def test_warc_round_trip_equals_sql_on_edge_pages(spark):
    pages = _pages(spark)
    db = duckdb.connect()
    db.register("edge", pages.toPandas())
    db.execute("CREATE VIEW pages AS SELECT * FROM edge")
    got = warc.archived_pages(spark, pages, new_work_dir(spark, "warc-test"), file_bytes=300)
    assert difference(got, db, sql.OP13) is None
    rows = got.collect()
    assert sorted(r.record_type for r in rows if r.page_id == 7) == ["response", "revisit"]
    assert {r.refers_to for r in rows if r.page_id in (1, None) and r.payload_bytes == 11} == {2}


def test_warc_empty_table(spark):
    assert warc.archived_pages(spark, _pages(spark).limit(0), new_work_dir(spark, "warc-empty")).count() == 0


def test_warc_salvage_skips_damage_and_logs_gaps():
    members = [warc.record(i, f"http://x/{i}", f"<p>{i}</p>".encode() * 20, i, i, i, True) for i in range(6)]
    plain = warc.zlib.decompress(members[5], 31)  # an uncompressed record at the end
    broken = bytearray(members[1])
    broken[len(broken) // 2] ^= 0xFF
    data = members[0] + bytes(broken) + b"garbage" + members[2] + members[3] + members[4][:-9] + plain
    records, gaps = warc.salvage(data)
    assert [r[2] for r in records] == [0, 2, 3, 5]
    assert len(gaps) >= 2 and all(a < b for a, b, _ in gaps)
    covered = sum(b - a for a, b, _ in gaps) + sum(len(m) for m in (members[0], members[2], members[3])) + len(plain)
    assert covered == len(data)


def test_warc_reader_recovers_from_a_damaged_file(spark):
    root = new_work_dir(spark, "warc-damage")
    pages = spark.createDataFrame([(i, f"http://x/{i}", f"<p>page {i}</p>" * 30) for i in range(40)], "page_id long, url string, html string")
    manifest = warc.write_archives(spark, pages.coalesce(1), root, file_bytes=1 << 30)
    name = manifest.collect()[0].name
    path = f"{root}/warc/{name}"
    with open(path, "rb") as f:
        data = bytearray(f.read())
    data[len(data) // 2 : len(data) // 2 + 50] = b"\0" * 50
    with open(path, "wb") as f:
        f.write(bytes(data))
    found = warc.read_archives(spark, root, manifest).collect()
    gaps = warc.quarantined(spark, root, manifest).collect()
    assert 35 <= len(found) < 40 and len(gaps) >= 1
    assert all(r.payload_digest == warc.base32_sha1((f"<p>page {r.page_id}</p>" * 30).encode()) for r in found)


def test_hard_negatives_keys_meet_in_every_block():
    """Keys of both sides must meet: at sf0.1 with many blocks and chunks the result is the SQL's."""
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    folder = "/root/testdata/sf0.1"
    found = hard_negatives.hard_negatives(spark, spark.read.parquet(f"{folder}/embeddings.parquet"), chunk_anchors=4, block_rows=256)
    assert found.count() > 0
    assert difference(found, connect(folder), sql.OP11) is None
