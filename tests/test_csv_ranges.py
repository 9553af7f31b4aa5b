"""CSV by ranges of bytes against Python's reader of the whole file."""

import csv
import io
import random

import pytest

from pairforge.sources import csv_ranges, metadata


def plain(path):
    with open(path, newline="", encoding="utf-8-sig") as f:
        return [[(r[k] or "") for k in r if k is not None] for r in csv.DictReader(f, restval="")]


def made(rng, rows, end):
    out = io.StringIO(newline="")
    write = csv.writer(out, lineterminator=end)
    write.writerow(["image_id", "dx", "note\nof two lines", "é"])
    for i in range(rows):
        write.writerow([f"i{i}", *(rng.choice(["", "a", 'say "hi"', "x,y", "line\nbreak", "\r\n", '"', "日本", "\n\n\n"]) for _ in range(rng.choice([2, 3, 3, 3, 4])))])
        if rng.random() < 0.1:
            out.write(end)
    return out.getvalue()


@pytest.mark.parametrize("end,size", [("\n", 7), ("\r\n", 40), ("\n", 10_000)])
def test_rows_are_those_of_the_whole_file(spark, tmp_path, end, size):
    text = made(random.Random(size), 60, end)
    (tmp_path / "m.csv").write_bytes(text.encode("utf-8-sig" if size == 40 else "utf-8"))
    want = plain(tmp_path / "m.csv")
    frame = csv_ranges.read(spark, str(tmp_path / "m.csv"), range_bytes=size)
    assert frame.columns == ["image_id", "dx", "note\nof two lines", "é"]
    assert sorted(map(list, frame.collect())) == sorted(want) and len(want) == 60
    for n in (0, 1, 23, 99):
        got = csv_ranges.read(spark, str(tmp_path / "m.csv"), n, range_bytes=size)
        assert sorted(map(list, got.collect())) == sorted(want[:n])
    if size < 100:
        parts = frame.rdd.getNumPartitions()
        assert parts > 10


def test_a_folder_is_read_in_the_order_of_its_names(spark, tmp_path):
    for name, ids in (("b.csv", "34"), ("a.csv", "12"), ("c.csv", "56")):
        (tmp_path / name).write_text("image_id,dx\n" + "".join(f"{i},d{i}" + ("\n" if i != ids[-1] else "") for i in ids))
    got = metadata.read_csv(spark, str(tmp_path), 3).collect()
    assert sorted(r.image_id for r in got) == ["1", "2", "3"]
    with pytest.raises(ValueError, match="no file"):
        csv_ranges.read(spark, str(tmp_path / "none.csv"))
    (tmp_path / "e.csv").write_text("image_id\n")
    with pytest.raises(ValueError, match="no rows"):
        metadata.read_csv(spark, str(tmp_path / "e.csv"))
