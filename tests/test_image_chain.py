"""Pictures reused across reports, against all pairs: near hashes, classes of copies, and places on both sides of the limit."""

import math
import random
from datetime import datetime, timedelta

from stormledger.operators import images as im


def test_near_classes_against_all_pairs(spark):
    rng = random.Random(7)
    seeds = [rng.getrandbits(64) for _ in range(30)]
    hashes = {0xFFFFFFFFFFFFFFFF, 0x8000000000000001, *seeds}
    for s in seeds:
        for n in (1, 5, 9, 10, 11, 12):
            hashes.add(s ^ sum(1 << b for b in rng.sample(range(64), n)))
        # Differences spread evenly over the four blocks, and all in one.
        hashes.add(s ^ sum(1 << b for b in (0, 5, 16, 20, 21, 32, 40, 48, 50, 63)))
        hashes.add(s ^ 0x3FF)
    rows = [(f"{h:016x}",) for h in hashes]
    got = {(r["a"], r["b"], r["distance"]) for r in im.near_classes(spark.createDataFrame([*rows, *rows, ("sabc",)], "class_id string")).collect()}
    want = {(f"{a:016x}", f"{b:016x}", (a ^ b).bit_count()) for a in hashes for b in hashes if f"{a:016x}" < f"{b:016x}" and (a ^ b).bit_count() <= 10}
    assert got == want and len(want) > 100


def test_classes(spark):
    pics = [(1, "a", "FFFF000000000000"), (2, "a", None), (3, "b", im.NO_HASH), (4, "b", None), (5, None, None), (6, None, "ffff000000000000")]
    got = {r["image_id"]: r["class_id"] for r in im.classes(spark.createDataFrame(pics, "image_id long, sha256 string, phash string")).collect()}
    assert got == {1: "ffff000000000000", 2: "ffff000000000000", 3: "sb", 4: "sb", 5: None, 6: "ffff000000000000"}


def test_reuse_against_all_pairs(spark):
    rng = random.Random(11)
    t0 = datetime(2024, 1, 8)
    reports, pics = [], []
    # Classes within a box of some 30 to 110 km, so that the outermost points alone settle few of them; a wide one; one that differs by time only.
    spread = {"00000000000000aa": (0.22, 1), "00000000000000ab": (0.25, 1), "0f0f0f0f0f0f0f0f": (0.3, 1), "1234567812345678": (0.45, 1), "ff00ff00ff00ff00": (5.0, 1), "f0f0f0f0aaaaaaaa": (0.01, 100)}
    for i in range(360):
        h, (wide, hours) = list(spread.items())[i % len(spread)]
        lat = None if i % 29 == 0 else 18.5 + rng.uniform(-wide, wide)
        reports.append((i, lat, 73.8 + rng.uniform(-wide, wide), None if i % 31 == 0 else t0 + timedelta(hours=rng.uniform(0, hours))))
        pics.append((i, i - i % 2 if i % 40 == 1 else i, f"s{h}", h))
    pics.append((1000, 3, "other", None))
    pics.append((1001, 4, None, None))
    made = im.classes(spark.createDataFrame(pics, "image_id long, id long, sha256 string, phash string"))
    table = spark.createDataFrame(reports, "id long, lat double, lon double, occurred_at timestamp")
    got = {r["image_id"]: r["verdict"] for r in im.reused(made, table).collect()}

    def km(a, b):
        p, q = math.radians(a[1]), math.radians(b[1])
        h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[2] - a[2]) / 2) ** 2
        return 2 * 6371 * math.asin(math.sqrt(h))

    def far(a, b):
        late = a[3] and b[3] and abs((a[3] - b[3]).total_seconds()) > 48 * 3600
        return bool(late or (a[1] is not None and b[1] is not None and km(a, b) > 50))

    by = {r[0]: r for r in reports}
    near = lambda p, q: p[2] == q[2] or (p[3] and q[3] and (int(p[3], 16) ^ int(q[3], 16)).bit_count() <= 10)
    want = {p[0]: "CONTRADICTS" if any(near(p, q) and far(by[p[1]], by[q[1]]) for q in pics) else "NEUTRAL" for p in pics if p[2]}
    assert got == want
    assert {v for k, v in want.items() if k % 6 == 0} == {"CONTRADICTS", "NEUTRAL"}


def test_no_images(spark):
    made = im.classes(spark.createDataFrame([], "image_id long, id long, sha256 string, phash string"))
    assert im.reused(made, spark.createDataFrame([], "id long, lat double, lon double, occurred_at timestamp")).count() == 0
