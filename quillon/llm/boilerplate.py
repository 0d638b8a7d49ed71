"""Main content of web pages: minimum-cut labelling of lines.

A classifier gives each line the costs of the two labels.  They become the
capacities to the terminals of a flow network; neighbouring lines, and lines of
one shape close to each other, are tied by smoothness edges.  The maximum flow
separates article from boilerplate.

The classifier is a logistic regression over the line's form, its place in the
page, words that pages use about themselves, how many hosts carry the same
line, and on how many pages of its own host it recurs.  It is fitted to lines whose label the form makes all but certain, on a
bounded sample of pages (about ``SAMPLE`` pages); the counts of lines are taken over
all pages.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.runtime import deal, table

#: Pages that the classifier is fitted on, give or take the chance of a hash.
SAMPLE = 4000
# What pages say about themselves, in English, German, French and Spanish; whole lines, lower case, numbers as #.
END = r"""
(topics|tags|keywords|schlagworte|schlagwörter|mots-clés|mots clés|etiquetas|temas|palabras clave) ?:.*
#+ (shares?|mal geteilt|partages?|veces compartido|compartidos?)
(share|print|email|e-mail|copy link|follow us|save for later|save|report an error|send us a tip|share (this article|on .*|via .*))
(drucken|merken|teilen|artikel teilen|fehler melden|link kopieren|folgen sie uns|per e-mail senden)
(imprimer|partager|signaler une erreur|enregistrer|copier le lien|suivez-nous|envoyer par e-mail)
(imprimir|compartir|guardar|avisar de un error|copiar enlace|síganos|enviar por correo)
more from .*|mehr von .*|mehr aus .*|plus de .*|más de [\w' .-]+
(most read|related stories|related|you may also like|editor's picks|in the same section|trending( now)?|more on this( story| topic)?|recommended( for you)?|read next|popular now|latest news)
(meistgelesen|mehr zum thema|das könnte sie auch interessieren|weitere artikel|aus dem ressort|empfehlungen der redaktion)
(à lire aussi|sur le même sujet|les plus lus|vous aimerez aussi|dans la même rubrique|à la une|le plus lu)
(noticias relacionadas|lo más leído|le puede interesar|también le puede interesar|más sobre este tema|en la misma sección|más leídas)
(comments?|kommentare?|commentaires?|comentarios?) ?\(#+\)
(reply · report|reply|antworten · melden|répondre · signaler|responder · denunciar)
(load more comments|weitere kommentare( laden)?|(voir|charger) plus de commentaires|(ver|cargar) más comentarios)
(log in to (join|comment).*|zum kommentieren.*|connectez-vous pour.*|inicie sesión para.*)
.*\(#+ (likes?|gefällt mir|j'aime|me gusta)\)
.* [–—-] [\w.-]*[_\w]#+[\w#]*
"""
PAGE = r"""
(imprint|impressum|privacy|privacy policy|datenschutz|agb|terms( of use| and conditions)?|careers|rss|contact( us)?|kontakt|contacto|help|faq|newsletter)
(mentions légales|aviso legal|confidentialité|privacidad|accessibility( statement)?|barrierefreiheit|accessibilité|accesibilidad|advertise with us|mediadaten|publicité et médias|karriere|términos de uso|conditions d'utilisation)
(back to top|nach oben|haut de page|volver arriba|top)
.*(all rights reserved|alle rechte vorbehalten|tous droits réservés|todos los derechos reservados)\.?
©.*|\(c\) #.*|copyright .*
reproduction in whole or in part.*|.* is not responsible for the content of external sites\.?|.*übernimmt keine (haftung|verantwortung).*|.*n'est pas responsable du contenu.*|.*no se hace responsable del contenido.*
registered office:.*|sitz der gesellschaft:.*|siège social ?:.*|domicilio social:.*
about [\w' .-]{2,40}|über [\w' .-]{2,30}|à propos de [\w' .-]{2,30}|sobre [\w' .-]{2,30}
this site (sets|uses) cookies.*|we (and our partners )?(use|set|process) (cookies|data).*|wir (und unsere partner )?(verwenden|setzen|nutzen|verarbeiten) (cookies|daten).*
nous (et nos partenaires )?(utilisons|déposons|traitons) (des )?(cookies|données).*|ce site (utilise|dépose) des cookies.*|diese (seite|website) (verwendet|setzt) cookies.*
(usamos|utilizamos) cookies.*|nosotros y nuestros socios.*|este sitio (usa|utiliza|instala) cookies.*
by clicking .*|mit „.*“ stimmen sie.*|en cliquant sur.*|al (pulsar|hacer clic|aceptar).*
(accept( all)?|reject( all| non-essential)?|cookie settings|manage (choices|settings|preferences).*|only necessary cookies)
(alle akzeptieren|alle ablehnen|nur notwendige cookies|einstellungen verwalten|ablehnen)
(tout accepter|tout refuser|continuer sans accepter|paramétrer|refuser)
(aceptar( todo| todas)?|rechazar( todo| todas)?|configurar|solo las necesarias)
(your privacy matters.*|you can withdraw (your )?consent.*|ihre privatsphäre.*|le respect de votre vie privée.*|su privacidad.*|sie können ihre einwilligung.*|vous pouvez retirer votre consentement.*|puede retirar su consentimiento.*)
"""
META = r"""
(updated|published|aktualisiert vor|veröffentlicht vor|mis à jour il y a|publié il y a|actualizado hace|publicado hace) .*#+.*
.{3,60}[ ]-?#+ ?°[cf]
(text size|schriftgröße|taille du texte|tamaño (de|del) (la )?(letra|texto)) ?:.*|(edition|ausgabe|édition|edición) ?:.*
(listen to this article|artikel anhören|écouter cet article|écouter l'article|escuchar (este|el) artículo).*
(you have|sie haben|il vous reste|le quedan|te quedan) .*#+.*(article|artikel|artículo).*
(latest headlines|aktuelle schlagzeilen|dernières nouvelles|últimas noticias|skip to content|zum inhalt( springen)?|aller au contenu|saltar al contenido)
(breaking( news)?|eilmeldung|live|alerte( info)?|dernière minute|flash|última hora|urgente) ?[:|–-].*
"""
INLINE = r"""
(advertisement|advertising|sponsored( content)?|promoted|anzeige|werbung|publicité|contenu sponsorisé|publicidad|contenido patrocinado)([ ]?[-–—:].*)?
(story|article) continues below.*|weiter nach der (anzeige|werbung).*|der artikel geht .* weiter.*|la suite après.*|(sigue|continúa) (leyendo )?(después|tras|abajo).*|la noticia continúa.*
sign up (for|to) .*|subscribe (to|now|for|today).*|get our .*newsletter.*|(jetzt )?newsletter (bestellen|abonnieren).*|(jetzt )?abonnieren.*|(recevez|abonnez-vous|inscrivez-vous).*|(reciba|suscríbase|suscríbete|apúntese|apúntate) .*
(enjoying|like) our (coverage|journalism).*|support (independent|our) .*|.*unterstützen sie (unabhängigen|unseren).*|.*soutenez (le|notre|un).*|.*apoye (el|nuestro|un).*|.*(unabhängigen journalismus|journalisme indépendant|periodismo independiente).*
(read (more|also|next)|see also|also on [\w' .-]+|recommended|related|more|lesen sie (auch|mehr)|mehr dazu|auch auf [\w' .-]+|(à )?lire aussi|à lire|aussi sur [\w' .-]+|lea también|lea además|también en [\w' .-]+|le puede interesar) ?:.*
.*\(#+ (comments?|kommentare?|commentaires?|comentarios?)\)
.*\((plus-artikel|subscribers? only|members only|premium|abonnés|réservé aux abonnés|solo suscriptores|para suscriptores)\)
.*[–—-] (#+ (hours?|minutes?|days?) ago|vor #+ (stunden?|minuten|tagen?)|il y a #+ (heures?|minutes|jours?)|hace #+ (horas?|minutos|días?))
"""


def _all(block: str) -> re.Pattern:
    return re.compile("|".join(f"(?:{x})" for x in block.strip().split("\n")))


_END, _PAGE, _META, _INLINE = map(_all, (END, PAGE, META, INLINE))
_SEPARATED = re.compile(r"[^\n]+?(?: ?[|•·›/»>] ?|  +)[^\n]+?(?: ?[|•·›/»>] ?|  +)")
_DIGITS = re.compile(r"\d+")
_STOP = re.compile(r"[.!?…。！？][\"”“»')\]]*$|[\"”»]$")
_YOU = re.compile(r"\b(?:you|your|we|our|us|sie|ihre?|wir|unsere?|vous|votre|vos|nous|notre|nos|usted|su|sus|nuestro|nuestra)\b")


def template(line: str) -> str:
    """A line as it is counted: lower case, runs of digits as #, blanks single."""
    return _DIGITS.sub("#", " ".join(line.lower().split()))


@lru_cache(1 << 16)
def cue(t: str) -> int:
    """0 none, 1 end of the article, 2 about the page, 3 about the article, 4 within the article."""
    t = t.replace("’", "'").strip()
    return 1 if _END.fullmatch(t) else 2 if _PAGE.fullmatch(t) else 3 if _META.fullmatch(t) else 4 if _INLINE.fullmatch(t) else 0


FEATURES = 22
#: Share of its host's pages from which on a line is the site's, if it is on three pages at least.
OWN = 0.3
#: Hosts per thousand from which on a line is common to many sites.
COMMON = 20
_FIRST = re.compile(r"(.+?[.!?。])(?:\s|$)")
_NUMBERED = re.compile(r"^(?:[•*·]\s+|#+\. )")
_TOKEN = re.compile(r"[^\W\d_]+|#+|[:,;–—(]")


def title_tokens(t: str) -> set[str]:
    """What a title is told by: the words, marks and length of the first sentence of a line."""
    m = _FIRST.match(t)
    words = _TOKEN.findall(_NUMBERED.sub("", m[1] if m else t))
    return {*words[:14], f"<{min(len(words), 16) // 2}>", "<start>" + (words[0] if words else "")}


def title_score(t: str, titles: dict[str, float]) -> float:
    """Log odds that a line is, or begins with, a title."""
    return max(-8.0, min(8.0, sum(titles.get(x, 0.0) for x in title_tokens(t)))) if titles else 0.0


def learn_titles(titles: list[str], prose: list[str]) -> dict[str, float]:
    """Log odds of the tokens of titles against those of prose, add-one smoothed."""
    n: dict[str, list[int]] = {}
    for k, ls in enumerate((titles, prose)):
        for x in ls:
            for w in title_tokens(x):
                n.setdefault(w, [0, 0])[k] += 1
    a, b = len(titles) + 2, len(prose) + 2
    return {w: float(np.log((x + 1) / a) - np.log((y + 1) / b)) for w, (x, y) in n.items() if x + y >= 3} if titles and prose else {}


class Page:
    """The non-blank lines of a page with what can be told of each by itself."""

    def __init__(self, lines: list[str], host: str, hosts: list[float], titles: dict[str, float], own: list[float] | None = None):
        self.lines, self.hosts, self.own = lines, hosts, own or [0.0] * len(lines)
        self.n = n = len(lines)
        self.t = t = [template(x) for x in lines]
        self.cue = [cue(x) for x in t]
        self.words = [len(x.split()) for x in t]
        self.stop = [bool(_STOP.search(x.strip())) for x in lines]
        site = re.sub(r"[^a-z]", "", (host or "").removeprefix("www.").split(".")[0])
        self.site = [bool(site) and re.sub(r"[^a-z]", "", x) == site for x in t]
        self.numbered = [bool(_NUMBERED.match(x)) for x in t]
        self.list = [
            not s and (len(re.findall(r"[|•·›/»>]|  +", x.strip())) >= 2 and bool(_SEPARATED.match(x.strip())) or y.startswith("* "))
            for x, y, s in zip(lines, t, self.stop)
        ]
        self.title = [title_score(x, titles) if not c else 0.0 for x, c in zip(t, self.cue)]
        self.prose = [c == 0 and s and w >= 3 and not y and not m for c, s, w, y, m in zip(self.cue, self.stop, self.words, self.list, self.numbered)]
        self.plain = [p and w >= 5 and x < 0 if titles else p and w >= 8 for p, w, x in zip(self.prose, self.words, self.title)]
        self.first = next((i for i in range(n) if self.plain[i]), n)
        self.last = max((i for i in range(n) if self.plain[i]), default=-1)
        self.crumb = [False] * n
        self.named = -1  # the headline, if a breadcrumb before the article ends with it
        for i in range(min(self.first, n)):
            for j in range(i + 1, min(self.first + 1, n, i + 4)):
                if not self.cue[i] and not self.cue[j] and self.words[i] > self.words[j] > 1 and len(t[j]) > 8 and t[i].endswith(t[j]):
                    self.crumb[i] = True
                    if self.named < 0:
                        self.named = j
        # up to two lines that say nothing of the page, as a last list item
        for _ in range(2):
            i = self.last + 1
            if self.last < 0 or i >= n or self.cue[i] or self.list[i] or self.site[i] or self.numbered[i] or self.words[i] < 2 or self.title[i] > 2 and hosts[i] < COMMON:
                break
            self.last = i
        told: dict[str, int] = {}
        for i in range(n):
            if self.plain[i]:
                for w in set(_TOKEN.findall(t[i])):
                    if len(w) > 3:
                        told[w] = told.get(w, 0) + 1
        self.near = []
        for i in range(n):
            ws = {w for w in _TOKEN.findall(t[i]) if len(w) > 4}
            self.near.append(sum(told.get(w, 0) > self.plain[i] for w in ws) / len(ws) if ws else 0.0)
        self.head = self._head()

    def _head(self) -> int:
        if self.named >= 0:
            return self.named
        best, at, related = (0.0, 0), -1, False
        for i in range(min(self.first, self.n)):
            related = related or self.cue[i] == 1
            if self.cue[i] or self.list[i] or self.numbered[i] or self.site[i] or self.words[i] < 2 or self.crumb[i]:
                continue
            common = float(np.log1p(self.hosts[i]))
            score = (2 * self.near[i] + 0.1 * self.title[i] - 0.8 * related + 0.2 * (i + 1 == self.first) - 0.5 * common, -i)
            if at < 0 or score > best:
                best, at = score, i
        return at if self.first < self.n else -1


def describe(page: Page) -> tuple[np.ndarray, np.ndarray]:
    """Features of the lines of a page, and labels that the form makes all but certain (1 boilerplate, 0 article, -1 open)."""
    n, t = page.n, page.t
    x = np.zeros((n, FEATURES), np.float32)
    y = np.full(n, -1, np.int8)
    for i in range(n):
        c, head, prose = page.cue[i], i == page.head, page.prose[i]
        title = page.title[i] > 0 and not head and page.hosts[i] < COMMON
        inside = page.head <= i <= page.last if page.head >= 0 else page.first <= i <= page.last
        many = float(np.log1p(page.hosts[i]))
        x[i] = (
            1, c == 1, c == 2, c == 3, c == 4, page.list[i], page.numbered[i] and page.title[i] > 0, page.stop[i], min(4.0, np.log1p(page.words[i])),
            i < page.head or page.head < 0 and i < page.first, head, bool(_YOU.search(t[i])), page.site[i], many * (not c and inside),
            many * (not inside), page.crumb[i], min(4.0, max(0.0, page.title[i])) * title, min(4.0, max(0.0, -page.title[i])) * prose,
            page.near[i] * title, not inside and not prose and i > page.last, page.own[i] * (not inside), page.own[i] * (inside and not c),
        )
        if c or page.list[i] or page.site[i] or page.crumb[i] or i < page.head or page.numbered[i] and page.title[i] > 0:
            y[i] = 1
        elif head or page.plain[i]:
            y[i] = 0
        elif title and page.title[i] > 2 or page.own[i] >= OWN and not prose:
            y[i] = 1
        elif not inside and not prose and page.hosts[i] > 0:  # on several hosts, outside of what is surely the article
            y[i] = 1
        elif inside and page.hosts[i] >= COMMON:
            y[i] = 0
    return x, y


def fit(x: np.ndarray, y: np.ndarray, *, rounds: int = 300, rate: float = 0.5, ridge: float = 1e-3) -> np.ndarray:
    """Weights of a logistic regression by gradient descent with momentum."""
    w = np.zeros(x.shape[1], np.float64)
    v = np.zeros_like(w)
    if not len(x):
        return w
    scale = np.maximum(1e-6, np.abs(x).max(0))
    z = x / scale
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        v = 0.9 * v - rate * (z.T @ (p - y) / len(y) + ridge * w)
        w = w + v
    return w / scale


def min_cut(costs: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Labels (true: boilerplate) of least total cost.

    ``costs[i]`` above 0 is what the label article costs for line i more than
    boilerplate, below 0 the other way round; an edge costs its weight if its ends differ.
    Shortest augmenting paths with adjacency lists; a page has some dozens of lines.
    """
    n = len(costs)
    s, t = n, n + 1
    graph: list[list[list]] = [[] for _ in range(n + 2)]

    def tie(a: int, b: int, c: float, back: float) -> None:
        graph[a].append([b, c, len(graph[b])])
        graph[b].append([a, back, len(graph[a]) - 1])

    for i, c in enumerate(costs):
        if c > 0:
            tie(s, i, c, 0.0)
        elif c < 0:
            tie(i, t, -c, 0.0)
    for a, b, c in edges:
        tie(a, b, c, c)
    while True:
        came: list[tuple[int, int] | None] = [None] * (n + 2)
        came[s] = (s, -1)
        q = deque([s])
        while q and came[t] is None:
            a = q.popleft()
            for k, (b, c, _) in enumerate(graph[a]):
                if c > 1e-9 and came[b] is None:
                    came[b] = (a, k)
                    q.append(b)
        if came[t] is None:
            return [came[i] is not None for i in range(n)]
        flow, b = float("inf"), t
        while b != s:
            a, k = came[b]
            flow = min(flow, graph[a][k][1])
            b = a
        b = t
        while b != s:
            a, k = came[b]
            graph[a][k][1] -= flow
            graph[b][graph[a][k][2]][1] += flow
            b = a


def label(lines: list[str], host: str, hosts: list[float], w: np.ndarray, titles: dict[str, float], own: list[float] | None = None, *, tie: float = 0.4) -> list[bool]:
    """Whether each non-blank line of a page is boilerplate."""
    page = Page(lines, host, hosts, titles, own)
    x, _ = describe(page)
    cost = np.clip(x @ w, -6, 6)
    n = len(lines)
    kind = [0 if page.prose[i] else 1 if page.list[i] or page.words[i] <= 3 else 2 for i in range(n)]
    edges = [(i, i + 1, tie * (1.0 if kind[i] == kind[i + 1] else 0.3)) for i in range(n - 1)]
    edges += [(i, i + 2, tie * 0.3) for i in range(n - 2) if kind[i] == kind[i + 2]]
    return min_cut([float(c) for c in cost], edges)


def _lines(text: str | None) -> list[tuple[int, str]]:
    return [(i, x) for i, x in enumerate((text or "").split("\n"), 1) if x.strip()]


def _host(url: str | None) -> str:
    m = re.match(r"(?:[a-z]+:)?//([^/?#]+)", (url or "").strip().lower())
    return m[1].split("@")[-1].split(":")[0] if m else ""


def boilerplate_lines(pages: DataFrame, id_col: str = "entity_id", url_col: str = "url", text_col: str = "text", *, sample: int = SAMPLE) -> DataFrame:
    """``(entity_id, line_no)`` of the non-blank lines that are not part of the article.

    Lines lie between line feeds and are counted from 1, blank ones too.  Null
    and empty texts give no row; a page without prose is all boilerplate; a null
    or broken url counts as a host without a name.  Repeated rows are labelled alike.
    """
    base = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.col(text_col).cast("string").alias("text"))
    base = base.where(F.length(F.trim("text")) > 0)

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hs, ts = [], []
            for u, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                mine = {template(x) for _, x in _lines(t)}
                hs += [_host(u)] * len(mine)
                ts += mine
            yield pa.RecordBatch.from_arrays([pa.array(hs, pa.string()), pa.array(ts, pa.string())], ["host", "t"])

    # equal texts of a url are one page, told by a digest of 128 bits
    page = F.md5(F.concat_ws("\0", F.coalesce("url", F.lit("")), "text")).alias("page")
    once = table(deal(base.groupBy(page).agg(F.any_value("url").alias("url"), F.any_value("text").alias("text"))), "pages")
    def sites(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([_host(u) for u in b.column(0).to_pylist()], pa.string())], ["host"])

    lines = once.select("url", "text").mapInArrow(explode, "host string, t string").select(F.xxhash64("t").alias("h"), F.xxhash64("host").alias("host"))
    # pages of each host that carry a line; a line alone on its page tells nothing and is left out
    per_host = table(lines.groupBy("h", "host").agg(F.count(F.lit(1)).alias("pages")), "lines")
    n_hosts = once.select("url").mapInArrow(sites, "host string")
    sizes = n_hosts.groupBy(F.xxhash64("host").alias("host")).agg(F.count(F.lit(1)).alias("of"))
    hosts = max(1, per_host.select("host").distinct().count())
    many = per_host.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h", (F.col("n") * 1000.0 / hosts).alias("n"))
    own = per_host.where("pages > 2").join(sizes, "host").select("h", "host", (F.col("pages") / F.col("of")).alias("own"))
    many, own = table(many, "line_hosts"), table(own, "line_homes")

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ps, hs, ts, ns = [], [], [], []
            for p, u, t in zip(*(b.column(i).to_pylist() for i in range(3))):
                host = _host(u)
                for k, (_, x) in enumerate(_lines(t)):
                    ps.append(p)
                    hs.append(host)
                    ts.append(template(x))
                    ns.append(k)
            yield pa.RecordBatch.from_arrays([pa.array(ps, pa.string()), pa.array(hs, pa.string()), pa.array(ts, pa.string()), pa.array(ns, pa.int32())], ["page", "host", "t", "k"])

    counted = once.select("page", "url", "text").mapInArrow(hashes, "page string, host string, t string, k int").select("page", "k", F.xxhash64("t").alias("h"), F.xxhash64("host").alias("host"))
    # one row a line in either table, so a line that is everywhere multiplies nothing
    one = counted.join(many, "h", "left").join(own, ["h", "host"], "left").where("n is not null or own is not null").select("page", "k", F.coalesce("n", F.lit(0.0)).alias("n"), "own")
    met = one.groupBy("page").agg(F.map_from_entries(F.collect_list(F.struct("k", F.struct("n", F.coalesce("own", F.lit(0.0)).alias("own"))))).alias("hosts"))  # a page's lines
    ready = table(once.join(met, "page", "left"), "ready")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, str, list[int], list[str], list[float], list[float]]]:
        for b in batches:
            for p, u, t, m in zip(*(b.column(c).to_pylist() for c in ("page", "url", "text", "hosts"))):
                ls = _lines(t)
                m = dict(m or ())
                seen = [m.get(k) or {"n": 0.0, "own": 0.0} for k in range(len(ls))]
                yield p, _host(u), [i for i, _ in ls], [x for _, x in ls], [x["n"] for x in seen], [x["own"] for x in seen]

    def headings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, host, _, ls, hs, own in rows(batches):
            p = Page(ls, host, hs, {}, own)
            if p.named >= 0:
                yield pa.RecordBatch.from_arrays([pa.array([p.t[p.named]]), pa.array([[p.t[i] for i in range(p.named + 1, p.n) if p.plain[i]]], pa.list_(pa.string()))], ["title", "prose"])

    fields = ["page", "url", "text", "hosts"]
    part = min(1.0, sample / max(1, ready.count()))  # pages by the hash of their hash, so that no rows are ordered for it
    chosen = table(ready.select(*fields).where(F.pmod(F.xxhash64(F.lit(3), "page"), F.lit(1_000_000)) < part * 1_000_000), "sample")
    t = chosen.mapInArrow(headings, "title string, prose array<string>").toArrow()
    titles = learn_titles(t.column("title").to_pylist(), [p for ps in t.column("prose").to_pylist() for p in ps])

    def seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, host, _, ls, hs, own in rows(batches):
            x, y = describe(Page(ls, host, hs, titles, own))
            keep = y >= 0
            if keep.any():
                yield pa.RecordBatch.from_arrays([pa.array(list(x[keep]), pa.list_(pa.float32())), pa.array(y[keep].astype(np.int32))], ["x", "y"])

    t = chosen.mapInArrow(seeds, "x array<float>, y int").toArrow()
    x = np.array(t.column("x").to_pylist(), np.float32).reshape(-1, FEATURES)
    w = fit(x, t.column("y").to_numpy().astype(np.float64) if t.num_rows else np.zeros(0))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ps, ns = [], []
        for p, host, nos, ls, hs, own in rows(batches):
            ps.append(p)
            ns.append([no for no, bad in zip(nos, label(ls, host, hs, w, titles, own)) if bad])
            if len(ps) >= 1000:
                yield pa.RecordBatch.from_arrays([pa.array(ps, pa.string()), pa.array(ns, pa.list_(pa.int64()))], ["page", "lines"])
                ps, ns = [], []
        yield pa.RecordBatch.from_arrays([pa.array(ps, pa.string()), pa.array(ns, pa.list_(pa.int64()))], ["page", "lines"])

    cuts = ready.select(*fields).mapInArrow(cut, "page string, lines array<bigint>")
    return base.select("id", page).join(cuts, "page").select(F.col("id").alias("entity_id"), F.explode("lines").alias("line_no"))
