"""The labelled table that the block classifier is trained on: pages whose blocks begin with + (main text) or - (the rest).

W<n> stands for n words of prose and is filled in by `pages()`, so that the table stays small and readable.
"""

from __future__ import annotations

import re

PAGES = (
    # an article element, with a menu, an advert and a footer around it
    """<html><head><title>-x</title></head><body><nav><ul><li><a href=a>-Home</a></li><li><a href=b>-News</a></li><li><a href=c>-W2</a></li></ul></nav>
    <div class="ad">-W8</div><article><h1>+W6</h1><p>+W12<p>+W60</p><p>+W3</p><p>+W25</p></article><footer>-&copy; example.com &middot; W9</footer></body></html>""",
    """<body><header><a href=/>-W1</a><h2>-W3</h2></header><nav><a href=a>-W2</a></nav><main><h1>+W9</h1><p>+W1</p><p>+W5 <a href=x>W2</a></p><p>+W90</p>
    <ul><li>+W4</li><li>+W14</li></ul><p>+W2</p></main><aside><h3>-W3</h3><p>-W30</p><p>-W12</p></aside><footer><p>-W20</p><p>-W3</p></footer></body>""",
    # an article with parts inside it that are none of its text
    """<body><div id="cookie-notice">-W25</div><article><header><h1>+W7</h1></header><p>+W40</p><div class="advert">-W15</div><p>+W2</p><p>+W18</p>
    <aside>-W40</aside><form>-W6</form><nav><a href=n>-W3</a></nav><blockquote>+W22</blockquote><p>+<a href=q>W4</a></p><footer>-W10</footer></article>
    <section class="comments"><h2>-W2</h2><p>-W45</p><p>-W4</p><article><p>-W33</p></article></section><div class="footer">-W7</div></body>""",
    """<body><div class="menu"><a href=a>-W1</a> <a href=b>W1</a></div><article><h2>+W5</h2><table><tr><td>+W2</td><td>+W1</td></tr></table><p>+W35</p><h3>+W3</h3><p>+W28</p>
    <div class="newsletter">-W14</div></article><div class="related"><h3>-W2</h3><a href=r>-W8</a></div><div>-W12</div></body>""",
    # no article element: words and links tell
    """<body><div><a href=a>-W1</a> <a href=b>W1</a> <a href=c>W2</a></div><div>-W2</div><h1>+W6</h1><div>+W45</div><div>+W60</div><div>+W15</div><div>+W30</div>
    <div>-<a href=l>W4</a></div><div>-<a href=l>W5</a></div><div>-W4 <a href=p>W3</a></div></body>""",
    """<body><table><tr><td>-<a href=1>W1</a></td><td>-<a href=2>W2</a></td><td>-<a href=3>W1</a></td></tr></table><p>-W3</p><h2>+W4</h2><p>+W80</p><p>+W33 <a href=x>W2</a></p>
    <p>+W21</p><p>-<a href=t>W3</a></p><p>-W3</p><p>-<a href=t>W2</a> <a href=t>W2</a></p></body>""",
    """<body><p>-<a href=1>W2</a></p><p>-<a href=2>W3</a></p><p>-<a href=3>W10</a></p><p>+W50</p><p>+W70</p><p>+W12</p><p>+W24</p><p>-<a href=4>W9</a></p><p>-W5</p></body>""",
    """<body><div class="sidebar"><p>-W35</p><p>-W50</p></div><div id="content"><h1>+W5</h1><p>+W18</p><p>+W55</p><p>+W9</p></div><div class="social"><a href=f>-W1</a></div>
    <div role="contentinfo">-W16</div></body>""",
    # names that speak against what holds the whole article: words and links overrule them
    """<body><nav><a href=a>-W2</a></nav><div class="sidebar"><h1>+W7</h1><p>+W40</p><p>+W65</p><p>+W14</p><p>-<a href=r>W6</a></p><p>+W28</p></div><footer>-W9</footer></body>""",
    """<body><div id="banner"><p>-<a href=a>W1</a></p><p>-<a href=b>W2</a></p><h2>+W5</h2><p>+W33</p><p>+W9</p><p>+W71</p><p>-<a href=c>W3</a></p></div></body>""",
    # no article either, but names tell apart what is long
    """<body><div class="navbar"><a href=a>-W2</a></div><div><h1>+W5</h1><p>+W42</p><p>+W17</p><p>+W88</p></div><div class="sidebar"><p>-W24</p><p>-W31</p></div></body>""",
    """<body><div><h2>+W7</h2><p>+W55</p><p>+W36</p><p>+W61</p></div><div id="comments"><h3>-W2</h3><p>-W44</p><p>-W9</p><p>-W27</p></div><div class="legal-notice">-W19</div></body>""",
    """<body><div class="cookie-banner">-W38</div><p>+W48</p><p>+W57</p><p>+W6</p><p>+W29</p><div class="newsletter-signup">-W16 <a href=s>W2</a></div></body>""",
    """<body><h1>+W6</h1><p>+W38 <a href=x>W9</a></p><p>+W52</p><aside><p>-W41</p><p>-W13</p></aside><p>+W24</p><form>-W18</form><p>+W47</p><p>+W9</p></body>""",
    """<body><div class="promo"><p>+W120</p><p>+W22</p></div><div class="menu"><a href=a>-W1</a> <a href=b>W2</a></div></body>""",
    """<body><div class="content-sidebar-wrap"><main class="has-sidebar"><h1>+W4</h1><p>+W31</p><p>+W8</p></main><div class="widget-area sidebar"><p>-W26</p></div></div></body>""",
    """<body><div class="post-content"><p>+W50</p><p>+W6</p></div><div class="post-comments"><p>-W40</p><p>-W12</p><p>-W3</p></div><div class="site-footer">-W11</div></body>""",
    """<body><h1>+W8</h1><p>+W30</p><p>+W26</p><p>+W44</p></body>""",
    """<body><p>+W40</p></body>""",
    """<body><article><p>+W1</p></article></body>""",
    """<body><article><h1>+W8</h1><p>+W11</p></article><footer>-W30</footer></body>""",
)


def pages() -> list[str]:
    return [re.sub(r"W(\d+)", lambda m: " ".join(["word"] * int(m[1])), p) for p in PAGES]
