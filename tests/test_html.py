"""Blocks of a page are whole without a budget, and marked as cut with one."""

from loamspark.operators.html import Budget, blocks_of

PAGE = "<main>" + "".join(f"<p>Line number {i} of the page</p>" for i in range(700)) + "<p>Line number 3 of the page</p></main>"


def test_a_long_page_is_read_whole():
    found, cut = blocks_of(PAGE)
    assert [t for _, t in found] == [f"Line number {i} of the page" for i in range(700)] and not cut


def test_a_budget_cuts_and_says_so():
    found, cut = blocks_of(PAGE, Budget())
    assert len(found) == 300 and cut
    assert not blocks_of("<p>Short page</p>", Budget())[1]
    found, cut = blocks_of(PAGE, Budget(nodes=50))
    assert 0 < len(found) <= 50 and cut


def test_empty_html_has_no_blocks():
    assert blocks_of("") == ([], False)
