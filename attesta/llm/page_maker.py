"""Invented pages with known main text, to train the block labeller on.

Layouts, tags and names vary apart from each other: an element may tell its part by its tag, by a
name in one of several languages, by the words in it, or only by its links, length and place."""

from __future__ import annotations

import numpy as np

_SYLLABLES = (
    "an be co da el fi go hu in jo ka le mi no or pa qui re sa ti un ve wo ya zu sch ver lich keit "
    "tion ment eau ció ado ñe ß ä ü é ing th sh ly ght str ough"
).split()
_SMALL = {
    "en": "the of and to in is that it was for on with as this by from are or".split(),
    "de": "der die und in den von zu das mit sich auf ist im dem nicht ein eine".split(),
    "fr": "de la le et les des en un du une que est pour qui dans par sur".split(),
    "es": "de la que el en y los se del las un por con una su para es".split(),
}
#: What a part is called in class and id attributes: of English pages, and of others.
_NAMES = {
    "nav": ("menu navbar main-nav topnav breadcrumb links navigation", "navigation hauptmenue navegacion menu-principal liens"),
    "header": ("site-header masthead page-header top-bar banner logo", "kopfzeile kopf entete cabecera encabezado"),
    "footer": ("footer site-footer copyright bottom legal colophon", "fusszeile impressum pied-de-page pie mentions"),
    "side": ("sidebar side related widget rail recommended trending most-read", "seitenleiste randspalte barre-laterale lateral meistgelesen"),
    "ad": ("ad ads advert advertisement sponsored promo ad-slot banner-ad", "werbung anzeige publicite publicidad anuncio"),
    "notice": ("cookie notice consent alert gdpr popup modal newsletter subscribe", "hinweis zustimmung avis bandeau aviso consentimiento"),
    "form": ("search login signup contact search-box", "suche anmeldung recherche connexion buscar acceso"),
    "comments": ("comments comment-list discussion responses replies reader-comments respond", "kommentare lesermeinungen commentaires reactions comentarios opiniones"),
    "share": ("share social tools tags share-buttons author-links", "teilen partager compartir etiquetas"),
    "main": ("content article post entry-content story article-body main-content entry text main", "inhalt beitrag artikel contenu texte-principal corps contenido cuerpo articulo"),
    "quote": ("pullquote pull-quote quote callout", "zitat kasten citation cita destacado"),
    "outer": ("page wrapper container row site layout", "seite rahmen conteneur contenedor"),
}
#: What such parts say.
_SAID = {
    "nav": (
        "home", "about us", "contact", "news", "sports", "archive", "services", "products", "startseite", "über uns",
        "kontakt", "nachrichten", "accueil", "à propos", "actualités", "inicio", "quiénes somos", "noticias", "menu", "skip to content",
    ),
    "header": ("welcome to", "the official site of", "your daily source for", "willkommen bei", "bienvenue sur", "bienvenido a"),
    "footer": (
        "© all rights reserved", "copyright", "terms of use", "privacy policy", "imprint", "powered by", "alle rechte vorbehalten",
        "impressum", "datenschutz", "tous droits réservés", "mentions légales", "todos los derechos reservados", "aviso legal", "©",
    ),
    "side": (
        "most read", "related articles", "popular posts", "you may also like", "latest news", "recommended for you", "trending now",
        "meistgelesen", "das könnte sie auch interessieren", "les plus lus", "à lire aussi", "lo más leído", "artículos relacionados", "read more",
    ),
    "ad": (
        "advertisement", "sponsored", "buy now", "shop the sale today", "limited offer, save up to 50 percent", "order now and get free shipping",
        "anzeige", "jetzt kaufen", "publicité", "achetez maintenant", "publicidad", "compra ahora", "special deal for new customers", "click here",
    ),
    "notice": (
        "we use cookies to improve your experience", "by continuing to browse this site you accept our use of cookies", "accept all",
        "manage your preferences", "subscribe to our newsletter", "sign up to read more free articles", "please disable your ad blocker",
        "wir verwenden cookies", "alle akzeptieren", "newsletter abonnieren", "nous utilisons des cookies", "tout accepter",
        "abonnez-vous à notre infolettre", "usamos cookies", "aceptar todas las cookies", "suscríbete al boletín", "our partners process your data",
    ),
    "form": (
        "search", "email address", "password", "log in", "sign up", "submit", "your name", "suche", "anmelden", "passwort",
        "rechercher", "se connecter", "envoyer", "buscar", "iniciar sesión", "enviar",
    ),
    "comments": (
        "comments", "leave a reply", "3 comments", "reader comments", "join the discussion", "kommentare", "kommentar schreiben",
        "commentaires", "laisser un commentaire", "comentarios", "deja un comentario",
    ),
    "said": ("reply", "says:", "wrote on", "posted at 10:24", "antworten", "schrieb am", "répondre", "a écrit", "responder", "dijo", "2 days ago", "likes"),
    "share": ("share", "tweet", "share this article", "print", "email", "tags:", "teilen", "drucken", "partager", "imprimer", "compartir", "follow us"),
}
_TAGS = {
    "nav": "nav", "header": "header", "footer": "footer", "side": "aside", "form": "form", "comments": "section",
    "main": "article", "quote": "aside",
}


#: Other scripts: ranges of letters as (first, number), and whether spaces part words.
_SCRIPTS = (
    (((0x3041, 80), (0x4E00, 600)), False), (((0x4E00, 1500),), False), (((0x0E01, 46),), False), (((0x0430, 32),), True),
    (((0x03B1, 25),), True), (((0x0627, 36),), True), (((0x0905, 50),), True), (((0xAC00, 900),), True),
)


class Maker:
    def __init__(self, seed: int):
        self._rng = np.random.default_rng(seed)

    def _one(self, items):
        return items[int(self._rng.integers(len(items)))]

    def _chance(self, p: float) -> bool:
        return bool(self._rng.random() < p)

    def _many(self, low: int, high: int) -> range:
        return range(int(self._rng.integers(low, high + 1)))

    def _letters(self, low: int, high: int) -> str:
        first, n = self._one(self._script[0])
        # some letters are much commoner than others
        return "".join(chr(first + int(n * self._rng.random() ** 2)) for _ in self._many(low, high))

    def _word(self) -> str:
        if self._script:
            return self._letters(2, 9) if self._script[1] else self._letters(1, 3)
        if self._small and self._chance(0.35):
            return self._one(self._small)
        return "".join(self._one(_SYLLABLES) for _ in self._many(1, 4))

    def _words(self, low: int, high: int) -> str:
        words = [self._word() for _ in self._many(low, high)]
        if self._script and not self._script[1]:
            ends = ["、" if self._chance(0.08) else "。" if self._chance(0.05) else "" for _ in words]
            return "".join(w + e for w, e in zip(words, ends)) + self._one(["。", "。", "", "！"])
        odd = self._one([".", ".", ",", "!", "***", " |"])
        for i in range(len(words)):
            if self._chance(0.1):
                words[i] += self._one([",", ".", odd])
        return " ".join(words).capitalize() + self._one([".", ".", ".", "", "!"])

    def _letters_of(self) -> str:
        return "".join(self._one(_SYLLABLES) for _ in self._many(1, 3))

    def _length(self) -> tuple[int, int]:
        return self._one([(1, 4), (3, 12), (10, 60), (10, 60), (30, 120)])

    def _saying(self, kind: str, telling: float = 0.8) -> str:
        """Words that a part of this kind says, at all lengths."""
        parts = [self._one(_SAID[kind])] if self._chance(telling) else [self._words(1, 8)]
        for _ in self._many(0, self._one([0, 1, 2, 6])):
            parts.append(self._one(_SAID[kind]) if self._chance(0.4) else self._words(1, 10))
        text = self._one([" ", ". ", " "]).join(parts[k] for k in self._rng.permutation(len(parts)))
        return text.upper() if self._chance(0.05) else text[:1].upper() + text[1:]

    def page(self) -> tuple[str, list[bool]]:
        """Markup, and for each block whether it is main text."""
        self._labels: list[bool] = []
        self._small = _SMALL[self._one([*_SMALL])] if self._chance(0.7) else []
        self._script = self._one(_SCRIPTS) if self._chance(0.2) else None
        # how parts are named, and whether tags tell them
        self._named = self._one(["english"] * 5 + ["foreign"] * 2 + ["random"] * 3 + ["none"] * 3 + ["shuffled"])
        self._random = [self._word() for _ in range(6)]
        self._tagged = self._chance(0.55)
        # where neither tells, words do
        self._telling = 0.95 if not self._tagged and self._named not in ("english", "foreign") else 0.5
        self._loose = self._chance(0.25)  # end tags are left out
        head = f"<!DOCTYPE html><html><head><title>{self._word()}</title></head><body>"
        body = self._table() if self._chance(0.15) else self._flow()
        return head + body + self._one(["</body></html>", ""]), self._labels

    def _flow(self) -> str:
        parts = []
        outer = [self._open("outer") for _ in self._many(0, 2)]
        for kind in self._some(["nav", "nav", "header", "notice", "ad", "form", "side"], 0.4):
            parts.append(self._chrome(kind))
        parts += [o for o, _ in outer]
        for kind in self._some(["notice", "ad", "nav", "side"], 0.2):
            parts.append(self._chrome(kind))
        parts.append(self._article())
        for kind in self._some(["share", "comments", "side", "ad", "form"], 0.3):
            parts.append(self._chrome(kind))
        parts += [f"</{tag}>" for _, tag in outer[::-1]]
        for kind in self._some(["comments", "side", "ad", "notice"], 0.25):
            parts.append(self._chrome(kind))
        if self._chance(0.75):
            parts.append(self._chrome("footer"))
        return "".join(parts)

    def _table(self) -> str:
        """Columns as cells of a table."""
        cell = lambda inner: f"<td{self._attribute('outer', 0.3)}>{inner}</td>"
        out = []
        if self._chance(0.7):
            out.append("<tr>" + cell("".join(self._cell(k) for k in self._some(["header", "nav", "ad"], 0.6)) or "&nbsp;") + "</tr>")
        row = []
        if self._chance(0.6):
            row.append(cell(self._cell(self._one(["nav", "side"]))))
        row.append(cell(self._article(bare=self._chance(0.5)) + "".join(self._chrome(k) for k in self._some(["share", "comments"], 0.25))))
        if self._chance(0.6):
            row.append(cell(self._cell(self._one(["side", "ad", "side"]))))
        out.append(f"<tr>{''.join(row)}</tr>")
        if self._chance(0.8):
            out.append("<tr>" + cell(self._cell("footer")) + "</tr>")
        return f"<table>{''.join(out)}</table>"

    def _cell(self, kind: str) -> str:
        """A part in a cell, or the cell itself."""
        if kind == "header" and self._chance(0.4):
            return self._block(self._one(["div", "h1", "p"]), f"<b>{self._words(1, 4)}</b>", False)
        return self._chrome(kind, wrapped=self._chance(0.4))

    def _some(self, kinds, p):
        order = self._rng.permutation(len(kinds))
        return [kinds[i] for i in order if self._chance(p)]

    def _attribute(self, kind: str, p: float = 0.85) -> str:
        if self._named == "none" or not self._chance(p):
            return ""
        if self._named == "random":
            name = self._one(self._random)
        else:
            own = self._one([*_NAMES]) if self._named == "shuffled" else kind
            name = self._one(_NAMES[own][self._named == "foreign"].split())
        extra = self._one(["", "", "", f" {self._word()}"])
        return self._one([' class="{}"', ' class="{}"', ' id="{}"', " class={}"]).format(name + extra if extra == "" else name)

    def _open(self, kind: str) -> tuple[str, str]:
        tag = _TAGS.get(kind, "div") if self._tagged and self._chance(0.85) else "div"
        if kind == "main" and tag == "article":
            tag = self._one(["article", "article", "main", "section"])
        # a part that nothing else tells has its tag or its name, or says what it is
        return f"<{tag}{self._attribute(kind, 0.6 if tag != 'div' else 0.9)}>", tag

    def _block(self, tag: str, text: str, main: bool, end: bool = True) -> str:
        self._labels.append(main)
        return f"<{tag}>{text}</{tag}>" if end else f"<{tag}>{text}"

    def _article(self, bare: bool = False) -> str:
        bare = bare or (self._tagged and self._named == "english" and self._chance(0.1))
        start, tag = ("", "") if bare else self._open("main")
        out = [start]
        if self._chance(0.85):
            title = self._block(self._one(["h1", "h1", "h2"]), self._words(2, 12), True)
            out.append(f"<header>{title}</header>" if tag == "article" and self._chance(0.1) else title)
        # an article that nothing marks is told by its length
        plain = not self._tagged or self._named in ("none", "random", "shuffled")
        before: list[str] = []
        few = plain and self._chance(0.12)  # a short article of full paragraphs
        for _ in self._many(2, 3) if few else self._many(3 if plain else 1, 14):
            kind = self._rng.random() * (0.7 if few else 1)
            low, high = self._one([(3, 12), (10, 60), (20, 60), (30, 120)]) if plain else self._length()
            low = max(low, 15) if few else low
            high = max(high, 2 * low) if few else high
            if kind < 0.7:
                text = self._words(low, high)
                before.append(text)
                if self._chance(0.06):  # a very long one
                    text = " ".join(before[-8:] + [before[int(k)] for k in self._rng.permutation(len(before))[:8]])
                if self._chance(0.25):
                    mark = self._one(["b", "em", "a href='/x'", "math", "span", "code"])
                    text += f" <{mark}>{self._word()}</{mark.split()[0]}> " + self._words(1, 9)
                out.append(self._block("p", text, True, not self._loose))
            elif kind < 0.77:
                out.append(self._block(self._one(["h2", "h3"]), self._words(1, 8), True))
            elif kind < 0.83:
                rows = "".join(self._block("li", self._words(1, 14), True, not self._loose) for _ in self._many(1, 6))
                list_ = self._one(["ul", "ul", "ol"])
                out.append(f"<{list_}>{rows}</{list_}>")
            elif kind < 0.87:
                out.append(self._block(self._one(["blockquote", "pre", "figcaption", "div"]), self._words(low, high), True))
            elif kind < 0.89 and self._chance(0.6):
                caption = self._block("figcaption", self._words(2, 25), True)
                out.append(f"<figure{self._attribute('main', 0.2)}><img src='/{self._letters_of()}.jpg'>{caption}</figure>")
            elif kind < 0.89:
                cells = "".join(self._block("td", self._words(1, 3), True) for _ in range(4))
                out.append(f"<table><tr>{cells}</tr></table>")
            elif kind < 0.91:
                # words set apart from the text that belong to it
                begin, own = self._open("quote")
                out.append(begin + self._block(self._one(["p", "blockquote"]), self._words(8, 40), True) + f"</{own}>")
            else:
                out.append(self._chrome(self._one(["ad", "share", "side", "side", "form", "notice"]), inner=True))
        if self._chance(0.2):
            out.append(self._chrome(self._one(["comments", "comments", "share", "footer"]), inner=True))
        return "".join(out) + (f"</{tag}>" if tag else "")

    def _chrome(self, kind: str, inner: bool = False, wrapped: bool = True) -> str:
        start, tag = self._open(kind) if wrapped else ("", "")
        named = tag not in ("", "div") or (self._named in ("english", "foreign") and ("class" in start or "id" in start))
        telling = 0.35 if named and not (inner and tag in ("aside", "section")) else 0.95
        link = lambda: f'<a href="/{self._word()}">{self._saying(kind, 0.3) if self._chance(0.3) else self._words(1, 6)}</a>'
        out = [start]
        if kind in ("nav", "footer", "side", "share", "header") and (kind == "nav" or self._chance(0.55)):
            if kind in ("side", "footer", "header") and (self._chance(0.7) or telling > 0.9):
                out.append(self._block(self._one(["h2", "h3", "h4", "p", "div"]), self._saying(kind, telling), False))
            row, list_ = self._one([("li", "ul"), ("li", "ul"), ("p", "div"), ("td", "table"), ("", "")])
            links = [link() for _ in self._many(2, 8)]
            if row:
                lines = "".join(self._block(row, x, False, not self._loose or row == "td") for x in links)
                out.append(f"<{list_}>{'<tr>' if row == 'td' else ''}{lines}</{list_}>")
            else:
                self._labels.append(False)
                out.append(self._one([" ", " | ", " &middot; "]).join(links))
            if kind == "footer" and self._chance(0.5):
                out.append(self._block("p", self._saying("footer"), False))
        elif kind == "form":
            for _ in self._many(1, 5):
                out.append(self._block(self._one(["div", "p", "button", "option", "legend"]), self._saying("form", telling), False))
            out.append("<input type=text>")
        elif kind == "comments":
            if self._chance(0.6) or telling > 0.9:
                out.append(self._block(self._one(["h2", "h3", "div"]), self._saying("comments", 0.95), False))
            holder = self._one(["div", "div", "article", "li"])
            for _ in self._many(1, 6):
                low, high = self._length()
                who = ""
                if self._chance(0.6) or telling > 0.9:
                    who = self._block(self._one(["div", "h4", "p"]), self._words(1, 2) + " " + self._one(_SAID["said"]), False)
                said = self._block("p", self._words(low, high), False)
                after = self._block("div", f"<a href='#r'>{self._one(_SAID['said'])}</a>", False) if self._chance(0.3) else ""
                out.append(f"<{holder}>{who}{said}{after}</{holder}>" if who or after else said)
        else:
            if kind in ("header", "side") and self._chance(0.5):
                level = self._one(["h1", "h1", "h2"] if kind == "header" else ["h2", "h3", "h4"])
                out.append(self._block(level, self._saying(kind, telling), False))
            for _ in self._many(0, 2):
                out.append(self._block(self._one(["p", "div"]), self._saying(kind, telling), False))
            if self._chance(0.5):
                self._labels.append(False)
                out.append(self._saying(kind, telling))
            else:
                out.append(self._block("p", self._saying(kind, telling), False))
        end = f"</{tag}>" if tag else "<hr>"
        return "".join(out) + end
