"""Items of all lengths have the same edit budget, and repetition stays within bounds."""

import random
import subprocess
import sys

import pytest
from rows import SCHEMA, row
from test_operators import edits

from tidebook.llm import decontaminate


@pytest.mark.parametrize("letters", ["ab", "abcdefgh "])
def test_every_length_has_the_whole_budget(letters):
    rng = random.Random(len(letters))
    draw = lambda n: "".join(rng.choice(letters) for _ in range(n))
    held = 0
    for m in (1, 2, 5, 9, 10, 12, 13, 14, 19, 24, 25, 26, 37, 38, 45, 60, 90, 130) * 12:
        item = draw(m)
        said = list(item)
        for _ in range(rng.randrange(int(0.08 * m) + 2)):
            at, kind = rng.randrange(max(1, len(said))), rng.randrange(3)
            said[at : at + (kind > 0)] = [] if kind == 1 else [rng.choice(letters)]
        text = draw(rng.randrange(120)) + "".join(said) + draw(rng.randrange(120))
        fewest = edits(item, text)
        found = decontaminate.Items([(7, item)]).search([text])
        assert [f[2] for f in found] == ([fewest] if fewest <= int(0.08 * m) else []), (item, text)
        held += bool(found)
    assert held > 80


@pytest.mark.parametrize("unit", ["-", "-=", ". . "])
def test_a_megabyte_of_repetition(unit):
    item, text = unit * (300 // len(unit)), unit * (1_000_000 // len(unit))
    made = decontaminate.Items([(1, item), (2, "x" + item), (3, "unrelated words that are not there at all")])
    assert made.search([text, "", "none"]) == [(0, 0, 0, 0, len(item)), (0, 1, 1, 0, len(item))]


def test_repetition_needs_little_memory():
    code = "from tidebook.llm import decontaminate as d; import resource; d.Items([(1, '-' * 300)]).search(['-' * 1_000_000]); print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss)"
    assert int(subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout) < 1 << 20  # kilobytes


def test_two_blocks_drop_what_one_block_drops(spark):
    items = [(k, f"item number {k} of the benchmark with words of its own {k * 7919}") for k in range(12)] + [(50, None), (51, "")]
    docs = [row(k, f"before {items[k % 12][1] if k % 3 else ''} after {k}") for k in range(60)] + [row(1, None), row(None, ""), row(None, items[3][1]), row(None, items[3][1])]
    df = spark.createDataFrame(docs, SCHEMA)
    bench = spark.createDataFrame(items, "item_id long, text string")
    one, some = (decontaminate.drop_contaminated(df, bench, block_chars=b) for b in (1 << 20, 200))
    assert one.columns == some.columns == df.columns
    key = lambda d: sorted(map(repr, d.collect()))
    assert key(one) == key(some) and one.count() == 22
    a, b = (decontaminate.contaminated(df, bench, block_chars=b) for b in (1 << 20, 200))
    assert key(a) == key(b)
