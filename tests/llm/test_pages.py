"""Main text of pages written by hand, which share no layout, class name list or generator with the training pages."""

from memjobs.llm import extraction

#: Name, page, its main text in blocks. The pages follow common layouts of news sites, blogs, documentation, forums and shops.
PAGES = [
    ("news", """<!doctype html><html lang=en><head><title>Ferry</title><script>var a = "<p>x</p>";</script></head><body>
<header class="site-top"><a href="/">The Harbour Post</a><nav aria-label="Sections"><ul><li><a href=/w>World</a><li><a href=/l>Local</a><li><a href=/s>Sport</a></ul></nav></header>
<main id="maincontent"><article itemprop="articleBody"><h1>Night ferry to return in spring</h1>
<p>The night ferry between the two ports will sail again from April, the operator said on Monday, after a break of three years.</p>
<p>Two ships will share the route. The first, built in 1998, has been given new engines; the second is hired for one season.</p>
<aside class="related-links"><h3>Read more</h3><ul><li><a href=/1>Port dues rise</a><li><a href=/2>Storm closes pier</a></ul></aside>
<p>&ldquo;We know how much people on the island have missed it,&rdquo; the harbour master said.</p></article>
<section class="comments" id="comments"><h2>Comments</h2><div class="comment"><p>About time they brought it back to us!</p></div><div class="comment"><p>Too dear for a family of four.</p></div></section></main>
<footer><p>&copy; The Harbour Post</p><ul><li><a href=/p>Privacy</a></ul></footer></body></html>""",
     ["Night ferry to return in spring", "The night ferry between the two ports will sail again from April, the operator said on Monday, after a break of three years.", "Two ships will share the route. The first, built in 1998, has been given new engines; the second is hired for one season.", "“We know how much people on the island have missed it,” the harbour master said."]),
    ("blog", """<html><body><div id="wrap"><div id="header"><h2><a href="/">Anna bakes</a></h2></div><div class="menu"><a href="/a">About</a> <a href="/r">Recipes</a></div>
<div class="post hentry"><h1 class="entry-title">Rye bread without a mixer</h1><div class="entry-content"><p>My grandmother never owned a mixer, and her bread was better than mine. This is how she made it on the farm.</p>
<ul><li>500 g rye flour, as coarse as you can get it</li><li>400 ml of warm water</li></ul><p>Leave the dough for twelve hours in a place that is not too warm.</p>
<blockquote><p>A good loaf is one that you have waited for.</p></blockquote></div></div>
<div class="sidebar widget-area"><h3>Archive</h3><ul><li><a href=/m1>May</a></li><li><a href=/m2>June</a></li></ul></div>
<div class="cookie-consent" role="dialog"><p>This site uses cookies to give you the best experience. <button>Accept</button></p></div></div></body></html>""",
     ["Rye bread without a mixer", "My grandmother never owned a mixer, and her bread was better than mine. This is how she made it on the farm.", "500 g rye flour, as coarse as you can get it", "400 ml of warm water", "Leave the dough for twelve hours in a place that is not too warm.", "A good loaf is one that you have waited for."]),
    ("manual", """<body><nav class="toc"><ol><li><a href="#1">Install</a><li><a href="#2">Use</a></ol></nav><main role="main"><section><h1>Installing the pump</h1>
<p>Switch the supply off before you begin. The pump must stand on level ground, with 20 cm free on each side.</p><h2>Tools</h2><ol><li>Spanner, size 13<li>Sealing tape</ol>
<table><tr><th>Model</th><th>Flow</th></tr><tr><td>P10</td><td>10 litres a minute</td></tr></table><pre>pump --test   --time 30</pre></section></main>
<form action="/feedback" class="feedback"><label>Was this page helpful to you?</label><input type=radio><button>Send</button></form><footer class="foot">Version 3, edited in May</footer>""",
     ["Installing the pump", "Switch the supply off before you begin. The pump must stand on level ground, with 20 cm free on each side.", "Tools", "Spanner, size 13", "Sealing tape", "Model", "Flow", "P10", "10 litres a minute", "pump --test --time 30"]),
    ("german", """<html><body><div class="kopf header"><img src=logo><a href="/">Startseite</a></div><div class="content"><h1>Der Garten im Oktober</h1>
<p>Im Oktober ist die Ernte vorbei, und der Boden braucht nun Ruhe und Schutz vor dem ersten Frost.</p><p>Laub darf liegen bleiben: Es wärmt die Erde und gibt den Igeln ein Winterquartier.</p>
<div class="advert"><p>Jetzt Gartenmöbel bis zu 50 % billiger kaufen!</p></div><p>Wer jetzt Zwiebeln setzt, hat im März die ersten Blüten.</p></div>
<div id="footer"><a href=/i>Impressum</a> | <a href=/d>Datenschutz</a></div></body></html>""",
     ["Der Garten im Oktober", "Im Oktober ist die Ernte vorbei, und der Boden braucht nun Ruhe und Schutz vor dem ersten Frost.", "Laub darf liegen bleiben: Es wärmt die Erde und gibt den Igeln ein Winterquartier.", "Wer jetzt Zwiebeln setzt, hat im März die ersten Blüten."]),
    ("broken", """<body><div class=nav><a href=a>Home</a><a href=b>Shop</a></div><article><h2>Clock repaired</h2><p>The town hall clock is going again after a winter of silence<p>A watchmaker from the next village mended it in his own time and asked for no pay
<div class="share-tools"><a href=f>Share</a><a href=t>Post</a></div><p>The council has thanked him with a dinner</article><div class=footer>All about the town""",
     ["Clock repaired", "The town hall clock is going again after a winter of silence", "A watchmaker from the next village mended it in his own time and asked for no pay", "The council has thanked him with a dinner"]),
    ("short", """<html><body><header><h1>Daily notes</h1></header><article><p>Rain all day. The river is up to the second step of the old bridge.</p></article><footer>Daily notes, 2021</footer></body></html>""",
     ["Rain all day. The river is up to the second step of the old bridge."]),
]


def test_hand_written_pages():
    found = extraction.extract_all([html for _, html, _ in PAGES], extraction.trained())
    hit = made = wanted = 0
    for (_, _, blocks), text in zip(PAGES, found, strict=True):
        got = text.split("\n\n") if text else []
        size = lambda bs: sum(len(b.split()) for b in bs)
        hit, made, wanted = hit + size([b for b in got if b in blocks]), made + size(got), wanted + size(blocks)
    precision, recall = hit / made, hit / wanted
    print(f"precision {precision:.3f}, recall {recall:.3f} of words in whole blocks")
    assert precision >= 0.9 and recall >= 0.9
