"""Pages written by hand, unlike those that the labeller learns from, and their articles."""

PAGES = {
    "bare text": (
        "<html><body>The mill was built in 1840 by two brothers.<br>It stood for a century.<p>Its wheel is still there today.</body></html>",
        "The mill was built in 1840 by two brothers. It stood for a century.\nIts wheel is still there today.",
    ),
    "table layout": (
        "<body bgcolor=white><table width=100%><tr><td><a href=/>Home</a> | <a href=/blog>Blog</a> | <a href=/me>About me</a></td></tr><tr><td><h1>My garden in spring</h1>"
        "<p>The tulips came up early this year, and the frost took half of them.</p><p>I will plant more in the fall.</p></td></tr><tr><td>Copyright 2003 Joe</td></tr></table></body>",
        "My garden in spring\nThe tulips came up early this year, and the frost took half of them.\nI will plant more in the fall.",
    ),
    "comment service": (
        "<body><article><h1>On rivers</h1><p>Rivers carry sand to the sea. They do so slowly.</p></article><div id='disqus_thread'><p>bob: great read, thanks!</p><p>ann: I disagree.</p></div></body>",
        "On rivers\nRivers carry sand to the sea. They do so slowly.",
    ),
    "formula": (
        "<body><nav><ul><li><a href=/>Index</a></li><li><a href=/a>Algebra</a></li></ul></nav><main><h1>Lines</h1><p>Let <math><mi>x</mi></math> be a point on the line.</p></main></body>",
        "Lines\nLet x be a point on the line.",
    ),
    "unclosed picture": (
        "<body><article><h1>Two boats</h1><p>The first boat sank.</p><svg><circle r=3><p>The second one came home.</p></article><footer>&copy; 2020 Harbor News</footer></body>",
        "Two boats\nThe first boat sank.\nThe second one came home.",
    ),
    "script off": (
        "<body><noscript>Please enable JavaScript to use this site.</noscript><header><a href=/>The Daily Post</a></header><article><h1>Rain again</h1><p>It rained on Monday, and on Tuesday too.</p></article></body>",
        "Rain again\nIt rained on Monday, and on Tuesday too.",
    ),
    "news": (
        "<body><header class='site-header'><div class='brand'>Evening Herald</div></header><nav class='site-nav'><a href=/w>World</a> <a href=/s>Sports</a></nav><main><article class='story'><h1>Bridge to close</h1>"
        "<p>The old bridge will close for repairs in May, the council said.</p><aside class='related'><h3>Related</h3><ul><li><a href=/1>Ferry returns</a></li></ul></aside><p>Drivers should use the tunnel.</p>"
        "<blockquote>We had no choice, said the mayor.</blockquote></article></main><footer class='site-footer'><p>All rights reserved.</p></footer></body>",
        "Bridge to close\nThe old bridge will close for repairs in May, the council said.\nDrivers should use the tunnel.\nWe had no choice, said the mayor.",
    ),
    "recipe": (
        "<body><div class='cookie-consent'>We use cookies. <button>OK</button></div><div class='content'><h1>Plain bread</h1><ul><li>500 g flour</li><li>water</li><li>salt</li></ul><ol><li>Mix everything.</li><li>Bake it for an hour.</li></ol></div>"
        "<form><p>Your email</p><input name=e><p>Subscribe</p></form></body>",
        "Plain bread\n500 g flour\nwater\nsalt\nMix everything.\nBake it for an hour.",
    ),
    "German": (
        "<body><div id='navigation'><ul><li><a href=/>Startseite</a></li><li><a href=/k>Kontakt</a></li></ul></div><div class='entry-content'><h2>Der Wald</h2><p>Im Wald stehen alte B&auml;ume. Sie sind sehr hoch.</p></div><div class='footer'>Impressum</div></body>",
        "Der Wald\nIm Wald stehen alte Bäume. Sie sind sehr hoch.",
    ),
    "no article": ("<body><nav><ul><li><a href=/>Home</a></li><li><a href=/c>Contact</a></li></ul></nav><footer>&copy; nobody</footer></body>", ""),
    "player": (
        "<body><article><h1>Concert</h1><video src=v.mp4>Your browser does not support video.</video><p>The band played for two hours. Nobody left early.</p></article></body>",
        "Concert\nThe band played for two hours. Nobody left early.",
    ),
    "notes": (
        "<body><section class='post-content'><h1>Notes on chess</h1><h2>Openings</h2><p>Move the center pawns first.</p><h2>Endings</h2><p>Kings become strong pieces.</p></section><section class='responses'><div class='response'>nice!</div><div class='response'>thanks</div></section></body>",
        "Notes on chess\nOpenings\nMove the center pawns first.\nEndings\nKings become strong pieces.",
    ),
}
