"""Main text of pages whose blocks were labelled by hand, most of them without an article element, by a model that was
fitted on generated pages."""

import pytest

from quillon.llm.html_crf import decode, fit_extractor, leaf_blocks, page_features

#: (page, main text by block)
PAGES = [
    (
        """<html><body><div class="topbar"><a href="/">Home</a> <a href="/news">News</a></div>
        <div id="content"><h1>Bridge reopens after repairs</h1>
        <p>The old stone bridge over the river Lem was opened again on Monday, after nine months of work on its two piers.</p>
        <p>Engineers had found cracks in the northern pier during an inspection last spring, and closed it to all traffic.</p></div>
        <div class="sidebar"><h3>Most read</h3><ul><li><a href="/1">Ten quick soups</a></li><li><a href="/2">Weather</a></li></ul></div>
        <div class="footer">Copyright 2021 The Valley Post</div></body></html>""",
        ["Bridge reopens after repairs", "The old stone bridge over the river Lem was opened again on Monday, after nine months of work on its two piers.", "Engineers had found cracks in the northern pier during an inspection last spring, and closed it to all traffic."],
    ),
    (
        """<body><nav><ul><li><a href="/a">Start</a></li><li><a href="/b">Archive</a></li></ul></nav><section class="post-body">
        <h2>How to keep bees through the winter</h2><p>A colony needs about fifteen kilograms of honey to come through the cold months without help.</p>
        <blockquote>Leave them alone as long as they hum, my grandfather used to say.</blockquote>
        <p>Wrap the hive only where the wind is strong, because damp does more harm than frost.</p></section>
        <section class="comments"><h3>2 comments</h3><p>Great post, thank you!</p><p>I lost mine last year.</p></section></body>""",
        ["How to keep bees through the winter", "A colony needs about fifteen kilograms of honey to come through the cold months without help.", "Leave them alone as long as they hum, my grandfather used to say.", "Wrap the hive only where the wind is strong, because damp does more harm than frost."],
    ),
    (
        """<body><table width="100%"><tr><td class="menu"><a href="i.html">Index</a><br><a href="n.html">Next</a></td><td>
        <h1>Notes on grafting</h1><p>Cut the scion in January, when the tree sleeps, and keep it in wet sand until the sap rises in the stock.</p>
        <p>The bark of both must meet on one side at least, or nothing will grow together.</p></td></tr></table>
        <p align="center"><small>Last changed 3 May 1999</small></p></body>""",
        ["Notes on grafting", "Cut the scion in January, when the tree sleeps, and keep it in wet sand until the sap rises in the stock.", "The bark of both must meet on one side at least, or nothing will grow together."],
    ),
    (
        """<body><header><h1>City Library</h1><form><input name=q><button>Search</button></form></header><main><h1>Opening hours change in August</h1>
        <p>During the renovation of the reading room the library opens at noon instead of nine from the first of August.</p>
        <ul><li>Monday to Friday from noon to eight in the evening</li><li>Saturday from noon to four in the afternoon</li></ul></main>
        <aside class="newsletter"><p>Sign up for our newsletter and never miss an event.</p></aside><footer><p>Imprint | Privacy</p></footer></body>""",
        ["Opening hours change in August", "During the renovation of the reading room the library opens at noon instead of nine from the first of August.", "Monday to Friday from noon to eight in the evening", "Saturday from noon to four in the afternoon"],
    ),
    (
        """<body><div class="cookie-banner"><p>We use cookies to improve this site. <a href="#">Accept</a></p></div><div class="wrap"><div class="story">
        <h1>A walk along the salt marsh</h1><p>We left the village before six, when the tide was still far out and the mud shone like a mirror.</p>
        <div class="ad">Advertisement: hiking boots at half price</div>
        <p>By noon the water had come back into the creeks, and the path along the dyke was the only dry one.</p></div></div>
        <div class="share"><a href="#">Share</a> <a href="#">Tweet</a></div></body>""",
        ["A walk along the salt marsh", "We left the village before six, when the tide was still far out and the mud shone like a mirror.", "By noon the water had come back into the creeks, and the path along the dyke was the only dry one."],
    ),
    (
        """<body><article><h1>Council votes on the tram</h1><p class="byline">By M. Orlo</p><p>With eleven votes against nine the council decided to build the second tram line through the old town.</p>
        <p>Work is to begin next year, if the state pays its share of the sixty million.</p></article><div class="related"><h4>Related</h4><a href="/x">Tram: all questions answered</a></div></body>""",
        ["Council votes on the tram", "By M. Orlo", "With eleven votes against nine the council decided to build the second tram line through the old town.", "Work is to begin next year, if the state pays its share of the sixty million."],
    ),
]


@pytest.fixture(scope="module")
def model(spark):
    return fit_extractor(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"))


def test_blocks_of_pages_labelled_by_hand(model):
    hit = miss = extra = 0
    for page, want in PAGES:
        blocks = leaf_blocks(page)
        found = [b[1] for b, y in zip(blocks, decode(model, page_features(blocks)), strict=True) if y]
        print(sorted(set(want) - set(found)), sorted(set(found) - set(want)))
        hit += len(set(want) & set(found))
        miss += len(set(want) - set(found))
        extra += len(set(found) - set(want))
    print(hit, miss, extra)
    assert hit / (hit + miss) >= 0.9 and hit / (hit + extra) >= 0.9
