"""Benchmark items without an id share windows with others."""

from ripplemark.llm import contamination


def test_a_null_item_shares_a_window():
    index = contamination.index_items([(2, b"a b c"), (None, b"a b c"), (1, b"a b c")], 13)
    (group,) = index.groups
    assert [index.ids[x] for x in group.items] == [None, 1, 2] and group.bounds.tolist() == [0, 3]
