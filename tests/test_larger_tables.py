"""Queries on tables longer than the small ones, against DuckDB."""

import tracemalloc

import duckdb
import numpy as np
import pytest

from reelframe.codecs import gif, png
from reelframe.operators import blocks, media, rules
from reelframe.plans import catalog
from reelframe.sources import views
from test_queries import rows


@pytest.fixture
def same_as_sql(spark, tmp_path):
    """Whether a query gives what its SQL does on tables made by statements over the small ones."""

    def check(name: str, **tables: str) -> None:
        con = duckdb.connect()
        con.execute("SET TimeZone = 'UTC'")
        for t, made in tables.items():
            con.execute(f"COPY ({made}) TO '{tmp_path}/{t}.parquet'")
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
        df = catalog.QUERIES[name](spark, str(tmp_path))
        cur = con.execute(catalog.ORACLES[name])
        cols = [c[0] for c in cur.description]
        assert rows(df.columns, df.collect()) == rows(cols, cur.fetchall())

    return check


def test_alpha_of_clips_with_over_a_thousand_frames(same_as_sql, sf_dir):
    vectors = f"SELECT r * 1000 + row_number() OVER (ORDER BY vec_id) AS vec_id, embedding, vec_id % 2 AS label FROM '{sf_dir}/embeddings.parquet', range(5) AS t(r)"
    same_as_sql("alpha_reconcile", embeddings=vectors)


def _long_gif(n: int) -> bytes:
    frame = np.zeros((4, 4), np.uint8)
    return gif.write([frame] * n, np.array([[0, 0, 0], [9, 9, 9]], np.uint8), [10] * n, 1)


def test_damage_lists_the_images_of_a_file_a_fixed_number_of_times(monkeypatch):
    """Not once an image: a file of 61,000 frames was at it for an hour."""
    calls, listed = [], gif.Gif.images.fget
    monkeypatch.setattr(gif.Gif, "images", property(lambda g: calls.append(1) or listed(g)))
    for n in (10, 40):
        calls.clear()
        media._damaged(6, "gif", _long_gif(n))
        assert len(calls) < 3


def test_files_are_walked_and_decoded_without_holding_their_blocks_or_frames():
    n = 8000
    files = {"gif": _long_gif(n), "apng": png.write(np.zeros((n, 4, 4, 4), np.uint8))}
    for fmt, reader, rows in (("gif", blocks.GifBlocks, 2 * n + 3), ("apng", blocks.PngParts, 2 * n + 3)):
        tracemalloc.start()
        assert sum(1 for _ in reader().eval(files[fmt])) == rows
        assert sum(p.nbytes for p in media._shown(fmt, files[fmt])) == n * 64
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert most < len(files[fmt]) + (1 << 20)


def test_a_long_file_that_breaks_at_its_end_is_one_row(spark, monkeypatch):
    """Frames go out in parts, but none of a file that can't be decoded to its end."""
    data = _long_gif(40_000)
    files = spark.createDataFrame([(1, "gif", data), (2, "gif", data[:-6])], media.FILES)
    got = media.decode_files(files).groupBy("clip").agg({"frame_idx": "max", "rgba": "count", "error": "max"}).collect()
    assert {r.clip: (r["max(frame_idx)"], r["count(rgba)"], r["max(error)"]) for r in got} == {1: (39_999, 40_000, None), 2: (None, 0, "cut")}


@pytest.mark.parametrize("name", ["canvas_coverage", "drop_every_n"])
def test_rows_move_once_and_into_more_parts_the_longer_the_table(spark, sf_dir, capsys, name):
    parts = []
    with pytest.MonkeyPatch.context() as m:
        for rows_a_task in (1 << 30, 500, 250):
            m.setattr(views, "ROWS", rows_a_task)
            m.setattr(views.placed, "__defaults__", (rows_a_task,))
            df = catalog.QUERIES[name](spark, sf_dir)
            df.explain()
            moved = [line.split("hashpartitioning(")[1] for line in capsys.readouterr().out.splitlines() if "Exchange" in line]
            assert len(moved) == 1
            parts.append(int(moved[0].split(")")[0].rsplit(",", 1)[1]))
    assert parts[0] == 4 and parts[2] >= 2 * parts[1] - 1 > 20


def test_coverage_of_frames_with_gaps_and_outside(spark):
    """(number, x, y, w, h, disposal) on a canvas of 4 x 2: numbers may have gaps, a frame may lie outside."""
    rects = [(0, 0, 0, 2, 2, 2), (2, 0, 0, 1, 1, 1), (3, 9, 9, 1, 1, 1), (5, 3, 1, 4, 4, 3), (6, 0, 0, 0, 1, 1)]
    frames = spark.createDataFrame([(None, *r, 4, 2) for r in rects] + [(1, *r, 4, 2) for r in rects], "clip long, frame_idx long, x long, y long, w long, h long, disposal long, width long, height long")
    got = sorted((r.frame_idx, r.uncovered) for r in rules.coverage(frames).collect())
    assert got == [(i, n) for i, n in [(0, 4), (2, 7), (3, 7), (5, 6), (6, 7)] for _ in range(2)]
