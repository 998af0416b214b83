"""Pages that no weight was fitted on: other sites, other words, other names of classes."""

from loamdex.llm.labelled_pages import labelled

A = "Last winter the harbour froze for the first time in thirty years, and the pilots had to learn again how to steer by the sound of the ice."
B = "Nobody had kept the old charts, so the youngest of them drew new ones, day after day, on the backs of menus from the canteen."
C = "By March they knew every ridge."
D = "El puerto volvió a abrirse en abril, cuando el hielo se deshizo, y los barcos salieron uno tras otro hacia el sur."
X = "Our partners offer you the best prices for winter tyres, order before Sunday and save a lot of money on every set."
Y = "My grandfather was a pilot there too and he told us the same stories, thank you for writing this down for all of us."
NAV = "<ul><li><a href=/1>Front page</a><li><a href=/2>Politics</a><li><a href=/3>Culture</a><li><a href=/4>Podcasts</a></ul>"

LAYOUTS = [
    f"<body><div class='layout with-sidebar'>⟦<h1>Ice</h1><p>{A} {B}</p><p>{B} {C}</p>⟧</div><p>Short line</p></body>",
    f"<body><main>⟦<h1>Ice</h1><p>{A}</p>⟧<section id='social-history'>⟦<h2>Who they were</h2><p>{B}</p><p>{D}</p>⟧</section></main></body>",
    f"<body><div id=nav-bar>{NAV}</div>⟦<h1>Ice</h1><p>{A}</p><p>{B}</p><p>{C}</p>⟧<div id=page-footer>tail{' ' * 200}</div></body>",
    f"<body><nav class='main-menu'>{NAV}</nav><div class='adbox'><p>Ad</p></div><article class='story'>⟦<h1>Ice</h1><p>{A}</p>⟧<div class='ad ad-inline'>{X}</div>⟦<p>{B}</p><p>{D}</p>⟧</article><div class='comments-area'><h2>Two comments</h2><p>{Y}</p><p>{Y}</p></div><footer><p>The Harbour Post, since 1903</p></footer></body>",
    f"<body><header role=banner><h2>The Harbour Post</h2>{NAV}</header><div class='cookie-bar'><p>This site stores cookies on your device, go on if that is fine with you.</p><button>Fine</button></div><main id=content>⟦<h1>Ice</h1><p>{A}</p><blockquote>{C}</blockquote><p>{B} <a href=/x>{C}</a></p><ul><li>ice</li><li>wind</li></ul><p>End</p>⟧</main><aside class=sidebar><h3>Most read</h3>{NAV}<p>{X}</p></aside></body>",
    f"<body><table width=100%><tr><td colspan=2>{NAV}<tr><td><a href=/a>Left</a><br><a href=/b>Right</a><td>⟦<font size=5>Ice</font><br><br>{A}<br>{B}<p>{D}⟧<tr><td colspan=2>Made by hand, 1998</table></body>",
    f"<body><div class='wrap'><div class='head'><a href=/>Post</a> <a href=/l>Log in</a></div><div class='body-text'>⟦<p>{A}</p><p>{D}</p>⟧</div><form action=/s><p>Write to us and tell us what you think about it, we read it all.</p><textarea>here</textarea><input type=submit></form></div></body>",
    f"<body><div id=comments class='comment-section'><p>{Y}</p><p>{Y}</p><p>{Y}</p><p>{Y}</p></div><article>⟦<h2>Ice</h2><p>{A}</p>⟧</article></body>",
    f"<body><article>⟦<header><h1>Ice</h1></header><p>{A}</p><p>{B}</p><figure><figcaption>A ship</figcaption></figure><p>{C}</p>⟧<aside><p>{X}</p><p>{X}</p></aside>⟦<p>{D}</p>⟧<footer>Filed under <a href=/h>harbours</a></footer></article>{NAV}</body>",
    f"<body><div class='post-body'>⟦<h1>Ice</h1><p>{A}<p>{B}<p><i>{C}</i><p>{D}⟧</div><div class='post-share'><a href=/f>Share this</a> <a href=/t>Mail it</a></div><div class='related'><h4>More like this</h4><a href=/1>{C}</a><a href=/2>The last lamp</a></div><div class='newsletter'><p>{X}</p></div></body>",
    f"<body><div class='alert'><p>We are moving house in May, some pages may be missing until then.</p></div><section>⟦<h1>Ice</h1><p>{A}</p><p>{B}</p>⟧</section><section class='user-comments'><p>{Y}</p></section></body>",
    f"<body>⟦<p>{A}</p><pre>{B}</pre><p>Fin.</p>⟧</body>",
    f"<body><div role=navigation>{NAV}</div><div role=main>⟦<h1>Ice</h1><p>{D}</p><h2>Later</h2><p>{B}</p>⟧</div><div role=contentinfo><p>{X}</p></div></body>",
    f"<body><div><div><div><a href=/>Home</a> &gt; <a href=/c>Culture</a></div><div><div>⟦<div>Ice</div><div>{A}</div><div>{B}</div><div>{D}</div>⟧</div></div><div><a href=/1>One</a><a href=/2>Two</a></div></div></div></body>",
    f"<body><div class=sidebar><h3>About</h3><p>{X}</p>{NAV}</div><div class=entry>⟦<p>{A}</p><p>{B}</p><p>{D}</p>⟧</div><div class=sponsored><p>{X}</p></div><p><small>All rights reserved by the post.</small></p></body>",
]

PAGES = [labelled("<!DOCTYPE html><html><head><title>Ice</title></head>" + x + "</html>") for x in LAYOUTS]
