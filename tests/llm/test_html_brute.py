"""HTML extraction against brute force: decoding by all consistent labellings, splits by all thresholds, whole pages by both; tables with odd columns and long pages."""

import itertools
import random

import numpy as np

from lodeframe.llm import html_text

PAGES = [
    "<html><body><nav><a href=/>home</a></nav><article><p>One two three four, five six.</p></article></body></html>",
    "<div class=sidebar>menu</div><p>Text of the article, which is long enough to be read by someone.</p>",
    "<p>only</p>",
    "plain words",
    "<footer>© x</footer>",
    "",
    None,
]


def brute_labels(parents, odds):
    """The best sum of log-odds over labellings in which a node is kept only if its parent is; the root is always kept."""
    best, found = -np.inf, None
    for bits in itertools.product([False, True], repeat=len(parents) - 1):
        keep = (True, *bits)
        if all(keep[parents[i]] or not keep[i] for i in range(1, len(parents))):
            total = sum(odds[i] for i in range(1, len(parents)) if keep[i])
            if total > best + 1e-12:
                best, found = total, keep
    return best, found


def test_decoding_is_the_best_of_all_consistent_labellings():
    rng = random.Random(3)
    for _ in range(60):
        page = html_text.Page()
        for i in range(1, rng.randint(2, 11)):
            up = rng.randrange(i)
            for column, value in (("tags", "p"), ("parents", up), ("marks", 0), ("texts", ""), ("breaks", True), ("depths", page.depths[up] + 1), ("places", 0)):
                getattr(page, column).append(value)
        forest = html_text.Forest([page])
        odds = np.array([rng.uniform(-2, 2) for _ in page.tags])
        keep = html_text.decode(forest, odds)
        best, _ = brute_labels(page.parents, odds)
        assert all(keep[page.parents[i]] or not keep[i] for i in range(1, len(keep)))
        assert np.isclose(sum(odds[i] for i in range(1, len(keep)) if keep[i]), best)


def test_a_split_has_the_largest_gain_of_all():
    rng = np.random.default_rng(4)
    x = rng.integers(0, 6, (200, 3)).astype(np.float32)
    y = (x[:, 1] + rng.normal(0, 1.5, 200) > 2.5).astype(float)
    tree = html_text.Boosted(x, y, trees=1, levels=1, rate=0.5)
    p = y.mean()
    grad, hess = p - y, np.full(len(y), p * (1 - p))
    score = lambda mine: grad[mine].sum() ** 2 / (hess[mine].sum() + 1)
    gains = {(f, c): score(x[:, f] <= c) + score(x[:, f] > c) - score(np.ones(len(y), bool)) for f in range(3) for c in np.unique(x[:, f])[:-1]}
    f, cut = int(tree.feature[0][0]), float(tree.cut[0][0])
    left, right = x[:, f] <= cut, x[:, f] > cut
    assert np.isclose(score(left) + score(right) - score(np.ones(len(y), bool)), max(gains.values()))
    want = np.where(left, -0.5 * grad[left].sum() / (hess[left].sum() + 1), -0.5 * grad[right].sum() / (hess[right].sum() + 1)) + np.log(p / (1 - p))
    assert np.allclose(tree.log_odds(x), want)


def walked(trees, row):
    """The log-odds of one node, tree by tree."""
    score = trees.start
    for feature, cut, value in zip(trees.feature, trees.cut, trees.value):
        node = 0
        for _ in range(trees.levels):
            node = 2 * node + (2 if row[feature[node]] > cut[node] else 1)
        score += value[node - (2**trees.levels - 1)]
    return score


def test_pages_equal_brute_force(spark, tmp_path):
    trees = html_text.model()
    want = []
    for source in PAGES:
        page = html_text.parse(source)
        forest = html_text.Forest([page])
        odds = [walked(trees, row) for row in html_text.features([page], forest)]
        assert len(page.tags) <= 16
        want.append(html_text.joined(page, list(brute_labels(page.parents, odds)[1])))
    rows = [(i, f"u{i}", p, "a", "b", "c") for i, p in enumerate(PAGES)]
    spark.createDataFrame(rows, "page_id long, url string, html string, text string, digest string, record string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: (r.url, r.text, r.n_chars) for r in html_text.op7_html_text(spark, str(tmp_path)).collect()}
    assert got == {i: (f"u{i}", t, len(t)) for i, t in enumerate(want)}
    assert "which is long enough" in want[1] and want[5] == want[6] == ""


def test_a_very_long_page(spark):
    body = "".join(f"<p>Sentence number {i} of the article, with words enough.</p>" for i in range(20_000))
    pages = spark.createDataFrame([(1, "u", f"<nav><a href=/>menu</a></nav><article>{body}</article>")], "page_id long, url string, html string")
    got = html_text.extract(pages).first()
    assert got.text.startswith("Sentence number 0 of") and "Sentence number 19999 of" in got.text and "menu" not in got.text
