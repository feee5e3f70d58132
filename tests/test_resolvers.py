"""Files of four datasets by name, on a folder made for it."""

from pavestat.sources import resolvers


def touch(root, *paths):
    for p in paths:
        (root / p).parent.mkdir(parents=True, exist_ok=True)
        (root / p).write_bytes(b"x")  # Spark lists no empty files


def made(root):
    touch(root, "bdd100k/images/val/a.jpg", "bdd100k/images/train/a.jpg", "bdd100k/images/test/t.jpg", "bdd100k/images/train/b.jpg", "bdd100k/ll_seg_annotations/val/a.png", "bdd100k/ll_seg_annotations/train/x.png")
    touch(root, "Curvelanes/valid/images/c.jpg", "Curvelanes/valid/labels/c.lines.json", "Curvelanes/test/images/c.jpg", "Curvelanes/train/images/d.jpg")
    for k in range(25):
        touch(root, f"culane/driver_1/S1.MP4/{k:05d}.jpg", f"culane/driver_2/S2.MP4/{k:05d}.jpg")
    touch(root, *[f"culane/laneseg_label_w16_test/driver_1/S1.MP4/{k:05d}.png" for k in range(20)])
    touch(root, "culane/laneseg_label_w16/driver_1/S1.MP4/00000.png", "culane/laneseg_label_w16/driver_2/S2.MP4/00001.png", "culane/driver_2/S2.MP4/00000.lines.txt", "culane/driver_3/S2.MP4/00007.jpg", "culane/driver_4/E.MP4/0.lines.txt")
    touch(root, "TUSimple/train_set/clips/d1/7/20.jpg", "TUSimple/train_set/clips/d1/7/19.jpg", "TUSimple/train_set/seg_label/d1/7/20.png", "TUSimple/test_set/clips/d2/8/20.jpg", "other/thing.jpg")


def test_names_and_pools(spark, tmp_path):
    made(tmp_path)
    files = resolvers.listing(spark, str(tmp_path))
    short = lambda p: None if p is None else p.split(f"{tmp_path}/")[1]
    listed = {r.sample_id: r for r in resolvers.enumerated(files.union(files)).collect()}
    assert len(listed) == 4 + 3 + 51 + 3
    assert short(listed["bdd100k_val_a"].truth_path) == "bdd100k/ll_seg_annotations/val/a.png" and not listed["bdd100k_train_a"].truth_found
    assert listed["culane_driver_1_S1.MP4_00000"].split == "test" and "w16_test" in listed["culane_driver_1_S1.MP4_00000"].truth_path
    assert listed["culane_driver_2_S2.MP4_00001"].split == "train" and listed["culane_driver_2_S2.MP4_00001"].truth_found and not listed["culane_driver_1_S1.MP4_00021"].truth_found
    assert listed["tusimple_train_d1_7_20"].truth_found and not listed["tusimple_train_d1_7_19"].truth_found and listed["tusimple_test_d2_8_20"].split == "test"
    assert {r.sample_id for r in resolvers.pool(files).collect()} == {"bdd100k_val_a", "curvelanes_valid_c", "culane_driver_1_S1.MP4_00000", "culane_driver_1_S1.MP4_00010"}

    names = [("bdd100k", "a.JPG"), ("bdd100k", "b"), ("bdd100k", "t.jpg"), ("bdd100k", "gone"), ("bdd100k", None), ("curvelanes", "c"), ("curvelanes", "d.jpg"), ("culane", "s1.mp4"), ("culane", "S2"), ("culane", "e"), ("culane", "zz"), ("tusimple", "12"), ("odd", "a"), ("bdd100k", "b")]
    got = resolvers.resolve(spark.createDataFrame(names, "dataset string, file_name string"), files).collect()
    assert len(got) == len(names)
    by = {(r.dataset, r.file_name): (short(r.image_path), r.split, short(r.truth_path), r.num_frames, r.ambiguous, r.note) for r in got}
    assert by["bdd100k", "a.JPG"] == ("bdd100k/images/val/a.jpg", "val", "bdd100k/ll_seg_annotations/val/a.png", None, True, "")
    assert by["bdd100k", "b"] == ("bdd100k/images/train/b.jpg", "train", None, None, False, "truth missing")
    assert by["bdd100k", "t.jpg"][-1] == "test split has no truth" and by["bdd100k", "gone"] == by["bdd100k", None] == (None, None, None, None, False, "image not found")
    assert by["curvelanes", "c"] == ("Curvelanes/valid/images/c.jpg", "valid", "Curvelanes/valid/labels/c.lines.json", None, True, "") and by["curvelanes", "d.jpg"][-1] == "truth missing"
    assert by["culane", "s1.mp4"] == ("culane/driver_1/S1.MP4/00000.jpg", "train/val", "culane/laneseg_label_w16/driver_1/S1.MP4", 25, False, "a segment, not a single frame")
    assert by["culane", "S2"][:1] + by["culane", "S2"][3:5] == ("culane/driver_3/S2.MP4/00007.jpg", 1, True)
    assert by["culane", "e"] == (None, "train/val", None, 0, False, "segment without frames") and by["culane", "zz"][-1] == "segment not found under any driver"
    assert by["tusimple", "12"][-1].endswith("unresolved")
    assert resolvers.enumerated(files.limit(0)).count() == 0
