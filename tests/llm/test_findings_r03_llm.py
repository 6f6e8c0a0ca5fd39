"""What the third round of findings showed of the near-dedup stage."""

from kelora.llm import nearcopies


def test_fingerprints_tell_the_candidates_of_hubs(spark):
    """A node farther than the radius from its hub by SimHash is no candidate there, whatever its MinHash bands say."""
    rows = [(1, 0, 1, 0), (2, (1 << nearcopies.RADIUS) - 1, 1, 0), (3, (1 << (nearcopies.RADIUS + 1)) - 1, 1, 0), (4, -1, 1, -2), (5, -1, 1, 0)]
    kept = nearcopies.by_hub(spark.createDataFrame(rows, "node long, fp long, hub long, hub_fp long")).collect()
    assert sorted(r.node for r in kept) == [2, 4]
