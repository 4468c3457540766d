"""Near copies: the SimHash step, groups of edited texts without all pairs, scratch tables that go."""

import os
import random

from evalweave.llm import near, simhash
from evalweave.plans import shared
from tests.llm.test_pipeline import kept_by_brute_force


def edited(texts, seed=3):
    """Copies of one text, each with one to five words changed: many are alike in chains alone, most pairs are not."""
    rng = random.Random(seed)
    base = [f"w{i}" for i in range(150)]
    out = [list(base) for _ in range(texts)]
    for k, words in enumerate(out):
        for _ in range(1 + k % 5):
            words[rng.randrange(150)] = f"x{rng.randrange(400)}"
    return [(k, " ".join(w)) for k, w in enumerate(out)]


def test_group_of_edited_texts(spark, monkeypatch):
    """A group whose members share most shingles gives no all-pairs comparison."""
    rows, compared = edited(400), []
    plain = near._verified

    def counting(pairs, own, texts):
        compared.append(pairs.count())
        return plain(pairs, own, texts)

    monkeypatch.setattr(near, "_verified", counting)
    kept = {r.doc_id for r in near.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == kept_by_brute_force(rows)
    # Stars in buckets of bands are linear; what they leave apart must be, too.
    assert 1 < len(kept) < len(rows) and max(compared[:-1]) < near.BANDS * len(rows) and compared[-1] < len(rows)


def test_difference_from_the_common_part_loses_no_link(spark, monkeypatch):
    """The last step alone finds all links of one group, whatever the group has in common."""
    monkeypatch.setattr(near, "_fingerprinted", lambda own: own.selectExpr("key as a", "key as b").where("false"))
    monkeypatch.setattr(near, "_starred", lambda buckets, own, texts, known=None: (
        known[0].where("false"), known[1].where("false"), own.selectExpr("0L as bucket", "key", "key as root")))
    monkeypatch.setattr(near, "_rare", lambda keys, own, texts: None)
    other = [(1000 + k, " ".join(f"o{k % 7}v{i}" if i % 30 else f"o{k}" for i in range(120))) for k in range(60)]
    for rows in (edited(120), other, edited(40) + other):
        kept = {r.doc_id for r in near.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        assert kept == kept_by_brute_force(rows)


def test_fingerprints_propose(spark, monkeypatch):
    """The stage goes through the SimHash operator; its proposals are links only if the sets have the likeness."""
    seen, plain = [], simhash.links

    def recording(prints):
        found = plain(prints)
        seen.append(found.count())
        return found

    monkeypatch.setattr(simhash, "links", recording)
    long = [f"w{i}" for i in range(3000)]
    rows = [(1, " ".join(long)), (2, " ".join([*long[:-1], "z"])), (3, "five words are not enough"), (4, "five words are quite enough")]
    kept = {r.doc_id for r in near.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == {1, 3, 4} and seen and seen[0] > 0
    assert near.simhash.majority(near.shingles("")) == 0


def test_scratch_tables_go(spark):
    """What the stage leaves on shared storage does not grow with the texts."""
    folder = shared.shared_dir(spark).removeprefix("file:")
    held = lambda: {f for f in os.listdir(folder) if f.startswith("cut-")}
    before = held()
    near.keep_one(spark.createDataFrame(edited(50), "doc_id long, text string")).collect()
    assert len(held() - before) <= 2  # the identified rows and those that stay
