"""Near copies of few words, whose fingerprints may differ in any number of bits."""

from ledgerline.llm import resemblance


def test_short_near_copies_with_far_fingerprints_are_linked(spark):
    rows = []
    for k in (3687, 18770, 5):  # the first two differ in 28 and 27 bits, beyond the radius
        words = [f"w{k}x{i}" for i in range(9)]
        five, four = resemblance.shingles([" ".join(words).encode(), " ".join(words[:8]).encode()])
        assert (k == 5) == (((resemblance.fingerprint(five) ^ resemblance.fingerprint(four)) & (2**64 - 1)).bit_count() <= resemblance.RADIUS)
        rows += [(10 * k, " ".join(words)), (10 * k + 1, " ".join(words[:8])), (10 * k + 2, " ".join(words[:7]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for tile in (2048, 2):
        kept = sorted(r.doc_id for r in resemblance.keep_one(docs, tile=tile).collect())
        # seven words have 3 shingles: 0.75 of four and 0.6 of five, no near copy
        assert kept == sorted(10 * k + d for k in (3687, 18770, 5) for d in (0, 2))
