"""Labelled pages (html, main text), written for fitting the weights of HTML extraction.

A page is a layout filled with a topic's texts. In a layout, what stands
between ⟦ and ⟧ is main text."""

from __future__ import annotations

import re

_INLINE = re.compile(r"</?(?:a|abbr|b|cite|code|em|i|mark|q|small|span|strong|sub|sup|time|u)\b[^>]*>")


def labelled(layout: str, **texts: str) -> tuple[str, str]:
    """(html, main text) of a layout."""
    page = layout
    for key, value in texts.items():
        page = page.replace("{" + key + "}", value)
    main = " ".join(re.findall(r"⟦(.*?)⟧", page, re.S))
    main = re.sub(r"<[^>]*>", " ", _INLINE.sub("", main))
    return re.sub("[⟦⟧]", "", page), " ".join(main.split())


def topic(title: str, paragraphs: list[str], items: list[str], menu: str, boiler: dict[str, str]) -> dict[str, str]:
    links = [f'<a href="/{i}">{w}</a>' for i, w in enumerate(menu.split(", "))]
    sentences = paragraphs * 2
    return {
        "h": title, "p": "</p><p>".join(paragraphs), "br": "<br><br>".join(paragraphs), "p1": paragraphs[0], "p2": paragraphs[1], "p3": paragraphs[-1], "short": paragraphs[-1].split(". ")[0].split(", ")[0],
        "li": "".join(f"<li>{x}</li>" for x in items), "menu": "".join(f"<li>{x}</li>" for x in links), "links": " ".join(links), "bars": " | ".join(links), "divs": "".join(f"<div>{x}</div>" for x in links),
        "linked": re.sub(r"^(\S+ )(\S+ \S+)", r'\1<a href="/more">\2</a>', paragraphs[0]), "marked": re.sub(r"(\S+)$", r"<em>\1</em>", paragraphs[1]), "long": " ".join(sentences), **boiler,
    }


TOPICS = [
    topic("The bridge over the river", ["The council met on Tuesday to discuss the new bridge over the river.", "Several residents spoke against the plan, citing noise and the loss of two old trees, and asked for another study of the traffic before any contract is signed.", "A second hearing is set for the spring, when the engineers will present a revised drawing.", "Until then the ferry keeps running every twenty minutes, as it has for almost a century."],
          ["Cost so far: two million", "Opening planned for the autumn", "No tolls for bicycles"], "Home, News, Sport, Weather, Contact, About us, Archive",
          {"ad": "Buy two lamps today and get a third one free.", "note": "We use cookies to improve your visit. By going on you agree to our policy.", "foot": "&copy; 2024 The Paper. All rights reserved.", "by": "By Ann Lee", "form": "<label>Your mail <input name=mail></label><button>Send</button>", "c1": "I have lived there for years and never saw the need for this!", "c2": "Well said. The ferry is all we want, and the trees must stay where they are.", "offer": "Sign up for our weekly letter and never miss a story again.", "more": "Read also"}),
    topic("Bohneneintopf wie früher", ["Die Bohnen über Nacht in reichlich kaltem Wasser einweichen und gut abspülen.", "Die Zwiebeln langsam weich dünsten, dann die Gewürze zugeben und eine Minute rühren, bis alles duftet und die Küche nach Kümmel riecht.", "Bohnen und Brühe zugeben und eine Stunde leise köcheln lassen."],
          ["500 g weiße Bohnen", "Zwei große Zwiebeln", "Ein Liter Brühe"], "Start, Rezepte, Kochbuch, Küche, Kontakt, Impressum",
          {"ad": "Jetzt drei Töpfe zum Preis von zwei, nur diese Woche.", "note": "Diese Seite verwendet Cookies. Mit der Nutzung stimmen Sie dem zu.", "foot": "Impressum und Datenschutz &middot; Alle Rechte vorbehalten", "by": "Von Karl Huber", "form": '<input placeholder="Suche"><button>Suchen</button>', "c1": "Hat uns sehr gut geschmeckt, wir haben es schon zweimal gekocht!", "c2": "Bei mir brauchten die Bohnen fast zwei Stunden, sonst wunderbar.", "offer": "Melden Sie sich für unseren Newsletter an und erhalten Sie neue Rezepte.", "more": "Das könnte Sie auch interessieren"}),
    topic("Sur les cartes anciennes", ["Les cartes sont des arguments.", "Ce qu'une carte laisse de côté en dit autant sur son auteur que ce qu'elle montre, et les blancs des vieux atlas n'ont jamais été vides.", "Il faut les lire comme on lit des lettres : lentement, en pensant à qui les envoie.", "Oui."],
          ["Atlas de 1650", "Portulans de Majorque", "Le cadastre"], "Accueil, Articles, Livres, Photos, Contact",
          {"ad": "Abonnez-vous maintenant et recevez un atlas en cadeau.", "note": "Ce site utilise des cookies pour améliorer votre visite.", "foot": "Tous droits réservés &middot; Mentions légales", "by": "Par Luc Morel", "form": "<input type=text><button>OK</button>", "c1": "Très bel article, merci beaucoup pour ces images.", "c2": "Je ne suis pas d'accord : une carte est d'abord un outil pour se déplacer.", "offer": "Inscrivez-vous à notre lettre pour ne rien manquer.", "more": "À lire aussi"}),
]

for _topic, _other in zip(TOPICS, TOPICS[1:] + TOPICS[:1]):  # texts of another topic, for boilerplate that reads like an article
    _topic |= {"q": _other["p"], "q1": _other["p1"], "q2": _other["p2"], "qlong": _other["long"], "qshort": _other["short"], "qh": _other["h"]}

_HEAD = '<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>{h}</title><style>p{margin:0}</style><script>var x = "</p>";</script></head>'
_COMMENT = "<p>{c1}</p><p>{c2}</p><p>{c1} {c2}</p>"

LAYOUTS = [
    "<body><nav><ul>{menu}</ul></nav><div class=\"ad\">{ad}</div><article>⟦<h1>{h}</h1><p>{p}</p>⟧</article><footer>{foot}</footer></body>",
    "<body><header><a href=\"/\">Daily</a><ul>{menu}</ul></header><main>⟦<h1>{h}</h1><p>{p1}</p><p><b>{p2}</b><br>{p3}</p>⟧<section class=\"comments\">" + _COMMENT + "</section></main><aside><h3>{more}</h3><ul>{menu}</ul></aside><footer>{foot} {links}</footer></body>",
    "<body><div id=\"top\"><div class=\"menu\"><ul>{menu}</ul></div></div><div id=\"content\">⟦<h2>{h}</h2><p>{p}</p>⟧</div><div class=\"sidebar\"><p>{offer}</p><form>{form}</form></div><div id=\"footer\">{foot}</div></body>",
    "<body><div class=\"cookie-notice\">{note} <a href=\"/c\">More</a></div><table><tr><td>{links}</td><td>⟦<h1>{h}</h1>{br}⟧</td></tr></table><ul>{menu}</ul></body>",
    "<body><ul>{menu}</ul>⟦<p>{p}</p><blockquote>{p1}</blockquote><p>{p3}</p>⟧<ul><li><a href=\"/a\">Previous page</a></li><li><a href=\"/b\">Next page</a></li></ul></body>",
    "<body><nav>{links}</nav><article><header>⟦<h1>{h}</h1>⟧</header>⟦<p>{linked} <em>{p3}</em></p><ul>{li}</ul>⟧<div class=\"promo\">{ad}</div>⟦<p>{p3}</p>⟧</article><p>{more}: <a href=\"/x\">{qh}</a>, <a href=\"/y\">{by}</a>.</p><footer><a href=\"/legal\">Legal</a></footer></body>",
    "<body class=\"single post sidebar-right\"><div class=\"site-header\">{divs}</div><div class=\"layout with-sidebar\"><div class=\"post\">⟦<h1>{h}</h1><p>{p}</p><p>{marked}</p>⟧</div><div class=\"widget\">{offer}</div><div class=\"widget\"><h4>{more}</h4>{divs}</div></div><div class=\"site-footer\"><p>{foot}</p></div></body>",
    "<body><div role=\"navigation\">{bars}</div><div role=\"main\">⟦<h1>{h}</h1><p>{p}</p>⟧<div class=\"share-buttons social\">{links}</div></div><div role=\"complementary\"><p>{ad}</p><p>{offer}</p></div><div role=\"contentinfo\">{foot}</div></body>",
    "<body><div class=\"banner\"><img src=x alt=\"\">{ad}</div><div class=\"container main-content\">⟦<h1>{h}</h1><p>{p}</p><h2>{p3}</h2><p>{p2} {p1}</p><ol>{li}</ol>⟧</div><div class=\"related-posts\"><h3>{more}</h3><p>{qshort}</p><p>{q1}</p></div><div id=\"comments\"><h3>2</h3>" + _COMMENT + "</div><div class=\"copyright\">{foot}</div></body>",
    "<body><div class=\"modal popup subscribe\"><h2>{offer}</h2><form>{form}</form></div><div class=\"wrapper no-sidebar\"><div class=\"entry-content\">⟦<p>{p}</p><p>{long}</p>⟧</div></div><div class=\"breadcrumbs\">{links}</div><div class=\"disclaimer legal\"><p>{note}</p></div></body>",
    "<body><div hidden><p>{q2}</p></div><div style=\"display: none\"><p>{offer}</p></div><div aria-hidden=\"true\"><p>{q2}</p></div><main>⟦<h1>{h}</h1><p>{p}</p>⟧</main><dialog><p>{note}</p><button>OK</button></dialog></body>",
    "<body><article>⟦<h1>{h}</h1><p>{p1}</p>⟧<aside><h4>{more}</h4><p>{q2}</p><p>{qlong}</p><a href=1>{qshort}</a></aside>⟦<p>{p2}</p>⟧<form><p>{offer} {note}</p>{form}</form>⟦<p>{p3}</p>⟧<nav><p>{q1}</p>{links}</nav></article></body>",
    "<body><article>⟦<h1>{h}</h1>⟧<div class=\"advertisement ad-slot\"><p>{ad} {q2}</p></div>⟦<p>{p}</p>⟧<div class=\"newsletter-signup\"><p>{offer}</p></div><section id=\"comments\" class=\"comment-list\">" + _COMMENT * 4 + "</section><footer><p>{by}. {foot}</p></footer></article></body>",
    "<body><div class=\"page\"><div class=\"navbar\">{links}</div><section id=\"social-history\">⟦<h2>{h}</h2><p>{p}</p>⟧</section><section class=\"policy-notice-period\">⟦<p>{p2}</p><p>{p1} {p3}</p>⟧</section></div><div class=\"alert notice\">{note}</div><div class=\"pagination\">{bars}</div></body>",
    "<body><main><section id=\"related-work\">⟦<h2>{h}</h2><p>{p2} {p1}</p>⟧</section><section class=\"side-effects\">⟦<p>{p}</p><p>{p2}</p>⟧</section><section id=\"advert-history\">⟦<p>{p2} {p3}</p>⟧</section></main><div class=\"sponsored sponsor\"><p>{ad}</p></div></body>",
    "<body>⟦<p>{long}</p>⟧</body>",
    "<body>⟦<h1>{h}</h1>{br}⟧<hr><small>{bars}</small></body>",
    "⟦{long}⟧",
    "⟦{p1}⟧",
    "⟦{h}⟧",
    "<body>⟦<p>{short}</p>⟧</body>",
    "<body><article>⟦<p>{short}</p>⟧</article><nav>{links}</nav></body>",
    "<body><div class=\"header masthead\"><p>{by}</p>{links}</div><div class=\"story article-body\">⟦<p>{p1}</p><figure><img src=i><figcaption>{p3}</figcaption></figure><p>{p2}</p><table><tr><td>{short}</td><td>{h}</td></tr></table><pre>{p1}</pre>⟧</div><div class=\"promo-box recommended\"><p>{qshort}</p>{divs}</div><div class=\"bottom-links\">{bars}</div></body>",
    "<body><div id=\"sidebar-left\" class=\"side-bar\"><ul>{menu}</ul><p>{ad}</p></div><div class=\"blog-post hentry\">⟦<h1>{h}</h1><div>{p1}</div><div>{p2}</div><div>{p3}</div><p>{linked}</p>⟧</div><div class=\"respond reply discussion\"><p>{c1}</p><p>{c2}</p></div><div class=\"cookie-banner consent gdpr\"><p>{note}</p></div></body>",
    "<body><div class=\"topbar toolbar\">{links}</div><div class=\"text\">⟦<p>{p}</p><p><a href=\"/z\">{short}</a></p><p>{p2}</p><dl><dt>{short}</dt><dd>{p3}</dd></dl>⟧</div><div class=\"tags\">{links}</div><div class=\"author-bio\"><p>{by}</p></div><div class=\"login\"><form>{form}</form></div></body>",
    "<body><nav>{divs}</nav></body>",
    "<body><div class=\"comments\">" + _COMMENT * 6 + "</div><div>⟦<h1>{h}</h1><p>{p1}</p>⟧</div></body>",
    "<body><div class=\"user-comments reader-comments\">" + _COMMENT * 5 + "</div><article>⟦<h1>{h}</h1><p>{p1}</p>⟧</article></body>",
    "<body><div class=\"skip-link\"><a href=#c>Skip</a></div><div class=\"search-box search\"><form>{form}</form></div><section class=\"post-content\">⟦<h1>{h}</h1><h3>{p3}</h3><p>{p}</p>⟧</section><section class=\"post-comments\"><h2>{c1}</h2>" + _COMMENT + "</section><section class=\"post-footer\"><p>{foot}</p></section></body>",
    "<body><article>⟦<h1>{h}</h1><p>{p1}</p><p>{p2}</p>⟧<div class=\"notice\"><p>{note}</p></div>⟦<p>{p3}</p>⟧</article><div class=\"comment\"><p>{c1}</p></div><div class=\"comment\"><p>{c2}</p></div></body>",
]

# The same sites with one box each, named as sites name such boxes, of prose like the article's, so that nothing but the name tells it.
BOXES = (
    "ad ads advert advertisement adverts advertising banner sponsor sponsored promo promotion promoted sidebar side-bar widget nav navbar navigation menu submenu breadcrumb breadcrumbs cookie cookies "
    "consent gdpr privacy notice notices alert warning-bar popup modal overlay subscribe subscription newsletter signup share sharing share-buttons social social-links related recommended recommendations "
    "more-stories read-more trending popular comment comments comment-list commentlist respond replies reply discussion disqus footer foot header masthead topbar toolbar login register paywall pagination pager "
    "legal copyright disclaimer imprint search search-box author-bio tags teaser outbrain taboola feedback survey"
).split()
_BOXED = [
    "<body><article>⟦<h1>{h}</h1><p>{p}</p>⟧<div class=\"NAME\"><p>{q2} {q1}</p></div>⟦<p>{p2}</p>⟧</article></body>",
    "<body><div id=\"NAME\"><p>{q1}</p><p>{q2}</p></div><div>⟦<h1>{h}</h1><p>{p}</p><p>{long}</p>⟧</div></body>",
    "<body><div><div>⟦<p>{p}</p><p>{p2} {p1}</p>⟧</div><section class=\"site-NAME NAME-area\"><h3>{qh}</h3><p>{q2}</p></section></div></body>",
]
# What holds most of a page may be named after a box that it has.
_BOXED += ["<body><div class=\"has-NAME NAME-page\">⟦<h1>{h}</h1><p>{p}</p><p>{p2}</p>⟧<div>{links}</div></div></body>"]
#: Elements and attributes that mark such boxes by themselves.
MARKED = ("nav", "aside", "footer", "form", "dialog", "menu", "fieldset", "div hidden", "div role=navigation", "div role=complementary", "div role=contentinfo", "div role=search", "div role=banner", "div role=dialog", "div role=alert", 'div aria-hidden="true"', 'div style="display:none"')
_MARKED = [
    "<body><article>⟦<h1>{h}</h1><p>{p}</p>⟧<NAME><p>{q2} {q1}</p></END>⟦<p>{p2}</p>⟧</article></body>",
    "<body><NAME><p>{q1}</p><div>{q2}</div></END><div>⟦<h1>{h}</h1><p>{p}</p><p>{long}</p>⟧</div></body>",
]
#: Layouts of plain boxes, which no name tells from one another.
_PLAIN = [
    "<body><div>{links}</div><div>⟦<div>{h}</div><div>{p1}</div><div>{p2}</div><div>{p3}</div>⟧</div><div>{bars}</div></body>",
    "<body><div><div>{divs}</div></div><div><div>⟦{br}<br>{p2}⟧</div></div><div><div>{links}</div></div></body>",
    "<body><center>{bars}</center>⟦<h2>{h}</h2><div>{p2}<br>{p1}</div><div><b>{short}</b> {p2}</div><p>{p3}</p>⟧</body>",
    "<body><div>⟦<span>{p1}</span> <span>{p2}</span><div>{long}</div>⟧</div><div><a href=1>{qh}</a></div></body>",
    "<body><section>⟦<p>{p}</p>⟧</section><section>⟦<h2>{h}</h2><div>{p2} {p3}</div>⟧</section><ul>{menu}</ul></body>",
]

# The plainer sites count several times: prose that nothing speaks against is main text.
PAGES: list[tuple[str, str]] = 4 * [labelled(_HEAD + x + "</html>" if x.startswith("<body") else x, **t) for x in LAYOUTS + _PLAIN for t in TOPICS]
PAGES += [labelled(layout.replace("NAME", name), **TOPICS[(i + k) % len(TOPICS)]) for i, name in enumerate(BOXES) for k, layout in enumerate(_BOXED)]
PAGES += [labelled(layout.replace("NAME", name).replace("END", name.split()[0]), **t) for name in MARKED for layout in _MARKED for t in TOPICS]
