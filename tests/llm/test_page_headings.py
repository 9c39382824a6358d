"""Fixed headings of what stays, repeated notices, and deeply nested pages."""

import time

from proxyspark.llm import extract

WORDS = "amber birch cedar delta ember fjord grove heron inlet jetty knoll larch maple north ocean".split()


def _words(k, n):
    return " ".join(WORDS[(k * 7 + i * (k + 3)) % len(WORDS)] + str(k * i % 11) for i in range(n))


def _texts(spark, bodies):
    rows = [(i, f"https://one.example/{i}", f"<html><body>{b}</body></html>") for i, b in enumerate(bodies)]
    out = extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    return {r["page_id"]: r["text"] for r in out}


def _recipe(k):
    return (f"<h1>Dish {_words(k, 2)}</h1><h2>Ingredients</h2><ul><li>{_words(k, 3)}</li><li>{_words(k + 40, 4)}</li></ul>"
            f"<h2>Method</h2><p>{_words(k, 12)}</p>"
            f"<table><tr><th>Time</th><th>Heat</th></tr><tr><td>{_words(k + 9, 2)}</td><td>{_words(k + 5, 2)}</td></tr></table>")


def _recipe_text(k):
    return "\n".join([f"Dish {_words(k, 2)}", "Ingredients", _words(k, 3), _words(k + 40, 4), "Method", _words(k, 12),
                      "Time", "Heat", _words(k + 9, 2), _words(k + 5, 2)])


def test_fixed_headings_stay_in_an_article_and_notices_go(spark):
    notice = "<div class='x17'><h3>Good to know</h3><p>We write to you every week.</p></div>"
    got = _texts(spark, [f"<article>{_recipe(k)}{notice}</article>" for k in range(20)])
    assert got == {k: _recipe_text(k) for k in range(20)}


def test_fixed_headings_stay_outside_an_article_and_site_titles_go(spark):
    got = _texts(spark, [f"<div><h1>The Daily Pan</h1><h4>All recipes, every day</h4><div class='t'>{_recipe(k)}</div></div>" for k in range(20)])
    assert got == {k: _recipe_text(k) for k in range(20)}


def test_headings_of_removed_parts_go(spark):
    end = "<h2>Your choice</h2><p class='tip'>Press the button below.</p><h2>Replies</h2><div class='comments'><p>{}</p></div>"
    got = _texts(spark, [f"<article>{_recipe(k)}{end.format(_words(k, 5))}</article>" for k in range(20)])
    assert got == {k: _recipe_text(k) for k in range(20)}


def test_text_hashes_tell_texts_apart_and_ignore_markup():
    hashes = [extract.text_hashes(r)[r] for r in map(extract.tree_of, (
        "<div>ab <b>c</b>d</div>", "<div>a<i>bcd</i></div>", "<div>abdc</div>", "<div>abcd<script>x</script></div>", "", "<p> </p>"))]
    assert hashes[0] == hashes[1] == hashes[3] != hashes[2] and hashes[4] == hashes[5] == (0, 0)


def test_deep_and_long_pages_take_time_in_proportion():
    page = "<div>" * 10_000 + "deep text" + "</div>" * 10_000
    start = time.process_time()
    extract.styles(page)
    assert extract.main_text(page, frozenset({1})) == "deep text"
    assert time.process_time() - start < 1
    assert extract.main_text("<article>" + "<p>a b</p>" * 50_000 + "</article>", frozenset()) == "\n".join(["a b"] * 50_000)
