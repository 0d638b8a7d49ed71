"""Names of persons and organisations: parsing, blocking codes and comparison."""

from __future__ import annotations

import re
from functools import lru_cache

from quillon.llm.text import edits, fold, jaro_winkler, sound, unscan

# Titles and suffixes of person names.
TITLES = frozenset("mr mrs ms miss mme mlle dr prof professor capt captain gen general col colonel lt maj sgt sir lord lady herr frau sr. sra srta don dona hon rev fr sig signor signora monsieur madame".split())
JUNIOR = frozenset("jr junior ii fils jnr jun".split())
SENIOR = frozenset("sr senior snr i pere".split())
OTHER_SUFFIX = frozenset("iii iv phd md esq".split())
# Given names and their familiar and foreign forms.
NICKNAMES = {
    "alexander": "alex alec al sandy sasha xander lex sacha alexandre alessandro alejandro aleksandr aleksander alexandr alexei",
    "alexandra": "alexa sandra sasha lexi",
    "andrew": "andy drew andre andreas andrei andrzej andres",
    "anthony": "tony antonio anton antoine",
    "augustin": "gus august augustus augustine agustin austin auggie augie",
    "anastasia": "nastya stacy ana",
    "benjamin": "ben benny benji benjy bennie beniamino",
    "charles": "charlie chuck carlos karl carl carlo",
    "christopher": "chris kit topher christoph cristobal",
    "daniel": "dan danny daniele",
    "david": "dave davey davide",
    "edward": "ed eddie ned ted teddy eduard eduardo edouard edoardo eddy",
    "ekaterina": "katya katia kate catherine katherine kathy katie catalina caterina kat cathy yekaterina kitty",
    "elizabeth": "liz beth betty eliza lisa lizzie bess elisabeth isabel libby",
    "eugenia": "genie zhenya gena eugenie jenia evgenia yevgenia eugene evgeniya genia",
    "fatima": "fatma fatemeh fatimah fatema",
    "francisco": "paco pancho fran frank francis francesco francois franz cisco kiko frankie franco",
    "frederick": "fred freddie freddy fritz frederic federico friedrich frederik rick fredrick",
    "george": "jorge georg giorgio georges yuri jurgen",
    "giuseppe": "peppe pino beppe geppe peppino pepe",
    "gregory": "greg grisha gregor gregorio grigori gregg grigory",
    "henry": "harry hank hal henri enrico enrique heinrich",
    "hussein": "husayn hossein husain hussain hossain husein hussayn",
    "ignacio": "nacho ignatius ignazio inigo iggy",
    "ivan": "vanya iwan wanja vania ivo",
    "jacques": "jacky jack jacqui jakob james jacob jim jimmy jaques jaime giacomo",
    "jennifer": "jen jenny jenn jenna",
    "john": "jack johnny jon jan johann juan giovanni jean joao hans",
    "joseph": "joe joey jos jo jose josef iosif yosef yusuf josep jozef",
    "lawrence": "larry laurence lars lorenzo laurent lawrie lorenz laurie loren",
    "leonard": "leo len lenny leonardo lennie leon leonhard",
    "margaret": "maggie meg peggy greta margarita marge rita margie marguerite",
    "matthias": "matt matty matti mathias matthew matteo mateo matthieu matthyas mats",
    "maximilian": "max maxim maximiliano",
    "michael": "mike mick mickey misha mikhail michel miguel michele mikey mitch michal",
    "muhammad": "mohamed mohammed mehmet mohammad mohamad mo muhammed mahomet",
    "nikolai": "nick nicholas kolya nicolas nikolay nicola niko nikola nikolaus klaus nicolai",
    "patricia": "pat patty tricia trish patrizia",
    "penelope": "penny nell nelly",
    "philip": "phil felipe philippe filippo",
    "robert": "bob bobby rob robbie bert roberto rupert robby",
    "richard": "dick rick rich ricky richie ricardo riccardo rikhard dickie",
    "rosalinda": "rosa linda rose rosie roz rosalind lindy rosalynda rosalina",
    "samuel": "sam sammy samuele sammie",
    "sebastian": "seb basti bastian sebastien sebastiano bas",
    "susanna": "sue susan susie suzanne susana zuzanna",
    "stephen": "steve steven stefan esteban stefano etienne stephan stevie",
    "theodore": "ted teddy theo fyodor teodoro theodor",
    "thomas": "tom tommy thos tomas tommaso tomasz",
    "tobias": "toby tobi tobin tobiah",
    "vladimir": "vova volodya vlad wladimir",
    "wilhelmina": "mina willa wilma minnie billie",
    "william": "bill billy will willy wm guillermo wilhelm guillaume liam willie guglielmo",
}

_CANON: dict[str, set[str]] = {}
for _g, _n in NICKNAMES.items():
    for _x in [_g, *_n.split()]:
        _CANON.setdefault(sound(_x), set()).add(_g)

# Legal forms; the first of a line is its code.
LEGAL = (
    ("gmbh", "gesmbh", "ges mbh", "ges m b h", "gesellschaft mit beschrankter haftung", "g m b h"),
    ("ag", "aktiengesellschaft", "a g"),
    ("sa", "societe anonyme", "sociedad anonima", "spolka akcyjna", "s a"),
    ("sas", "societe par actions simplifiee", "s a s"),
    ("sarl", "societe a responsabilite limitee", "s a r l", "s ar l"),
    ("srl", "societa a responsabilita limitata", "s r l"),
    ("spa", "societa per azioni", "s p a"),
    ("bv", "besloten vennootschap", "b v"),
    ("nv", "naamloze vennootschap", "n v"),
    ("llc", "limited liability company", "l l c", "lc"),
    ("llp", "limited liability partnership", "l l p"),
    ("lp", "limited partnership"),
    ("plc", "public limited company", "p l c"),
    ("ltd", "limited"),
    ("inc", "incorporated"),
    ("corp", "corporation"),
    ("sl", "sociedad limitada", "s l"),
    ("spzoo", "sp zoo", "sp z oo", "sp z o o", "spolka z oo", "spolka z o o", "spolka zoo", "spolka z ograniczona odpowiedzialnoscia"),
    ("co", "company", "and co", "& co", "and company", "& company"),
)
_LEGAL = sorted(((tuple(x.split()), forms[0]) for forms in LEGAL for x in forms), key=lambda p: -len(p[0]))
# Words of the trades and forms of business, that tell no firm from another; those of a corpus are learned from it.
COMMON = frozenset(
    "international national general holdings holding group trading services service capital partners brothers industries industrial systems "
    "solutions management consulting logistics shipping maritime marine freight forwarding import export investments investment insurance brokerage energy "
    "oil gas petroleum mining metals steel cement construction engineering manufacturing machinery motors aviation railways travel hotels real estate water "
    "works power tools data centers security software electronics robotics optics glass ceramics plastics chemicals pharmaceuticals medical supplies "
    "diagnostics biotech foods beverages agro seeds fisheries timber paper packaging printing publishing textiles furniture films communications "
    "commodities tankers ship".split()
)

_PAREN = re.compile(r"\([^()]*\)?|\[[^\[\]]*\]?")
_TRADES = re.compile(r"\b(?:t/a|d/b/a|dba|trading as|c/o)\b.*$")
_WOUND = re.compile(r"\s[-–—]?\s*in (?:liquidation|administration|receivership)\b.*$")


@lru_cache(100_000)
def _canonical_given(t: str) -> frozenset[str]:
    return frozenset(_CANON.get(sound(t), ()))


def _words(name: str) -> list[str]:
    s = re.sub(r"[.'\"]", "", name)
    s = re.sub(r"[^a-z0-9&]+", " ", s)
    return s.split()


def letters(w: str) -> int:
    """The letters of a word as bits; one slip changes at most two of them."""
    m = 0
    for c in w:
        m |= 1 << (ord(c) & 31)
    return m


@lru_cache(4)
def _form_words(at: int) -> tuple[dict[str, list[int]], dict[str, list[int]]]:
    """Legal forms by their first or last word, and those of several words by such a word of more than four letters."""
    exact: dict[str, list[int]] = {}
    long: dict[str, list[int]] = {}
    for i, (form, _) in enumerate(_LEGAL):
        exact.setdefault(form[at], []).append(i)
        if len(form) > 1 and len(form[at]) > 4:
            long.setdefault(form[at], []).append(i)
    return exact, long


@lru_cache(100_000)
def _forms_at(w: str, at: int) -> tuple[int, ...]:
    """Legal forms whose first (0) or last (-1) word is ``w``, or for long words of several-word forms a slip of it."""
    exact, long = _form_words(at)
    near = [i for f, ks in long.items() if abs(len(f) - len(w)) <= 1 and (letters(f) ^ letters(w)).bit_count() <= 2 and edits(w, f, 1) <= 1 for i in ks]
    return (*exact.get(w, ()), *near)


def _is_form(ws: list[str], form: tuple[str, ...]) -> bool:
    return tuple(ws) == form or len(form) > 1 and all(edits(a, b, 1) <= (len(b) > 4) for a, b in zip(ws, form))


def _strip_legal(ws: list[str]) -> tuple[list[str], str]:
    code = ""
    for _ in range(3):
        for i in sorted({*_forms_at(ws[-1], -1), *_forms_at(ws[0], 0)}) if len(ws) > 1 else ():
            form, c = _LEGAL[i]
            k = len(form)
            if len(ws) <= k:
                continue
            if _is_form(ws[-k:], form):
                ws, code = ws[:-k], code if code and c == "co" else c
                break
            if (c != "co" or k > 1 and tuple(ws[:k]) != form) and _is_form(ws[:k], form):
                ws, code = ws[k:], c
                break
        else:
            break
    return ws, code


def parse_org(name: str | None, common: frozenset[str] = COMMON) -> tuple[str, tuple[str, ...], str] | None:
    """Stem, other words and legal form; null if nothing is left.

    The stem is the longest word that is not a common one, the words keep their order.
    """
    s = unscan(fold(name))
    s = _TRADES.sub("", _PAREN.sub(" ", s))
    s = _WOUND.sub("", s)
    ws = _words(s)
    while ws and ws[0] == "the":
        ws = ws[1:]
    ws, legal = _strip_legal(ws)
    ws = [w for w in ws if w not in ("&", "and", "the")]
    if not ws:
        return None
    rare = [w for w in ws if len(w) > 2 and w not in common and not _near_common(w, common)]
    if not rare:
        return ws[0] if len(ws) == 1 else " ".join(ws), (), legal
    stem = max(rare, key=len)
    i = ws.index(stem)
    # a stem that a hyphen or a space has cut in two
    if len(rare) > 1 and i + 1 < len(ws) and ws[i + 1] in rare and not any(_abbreviates(ws[i + 1], c) for c in common):
        return stem + ws[i + 1], tuple(ws[:i] + ws[i + 2 :]), legal
    if len(rare) > 1 and i > 0 and ws[i - 1] in rare and not any(_abbreviates(ws[i - 1], c) for c in common):
        return ws[i - 1] + stem, tuple(ws[: i - 1] + ws[i + 1 :]), legal
    return stem, tuple(ws[:i] + ws[i + 1 :]), legal


def cuts(w: str, most: int) -> set[str]:
    """``w``, and ``w`` with up to ``most`` letters left out; words at most so many slips apart have one in common."""
    now = {w}
    out = set(now)
    for _ in range(most):
        now = {x[:i] + x[i + 1 :] for x in now for i in range(len(x))}
        out |= now
    return out


@lru_cache(8)
def _cut(common: frozenset[str]) -> tuple[dict[str, list[str]], dict[str, list[tuple[str, int]]]]:
    """Words by what is left of them without a letter; long words with their letters by the first."""
    index: dict[str, list[str]] = {}
    long: dict[str, list[tuple[str, int]]] = {}
    for c in common:
        for k in cuts(c, 1):
            index.setdefault(k, []).append(c)
        if len(c) > 7:
            long.setdefault(c[0], []).append((c, letters(c)))
    return index, long


def _near(w: str, common: frozenset[str], least: int) -> bool:
    index, long = _cut(common)
    for k in (w, *(w[:i] + w[i + 1 :] for i in range(len(w)))):
        for c in index.get(k, ()):
            if len(c) >= least and edits(w, c, 1) <= 1:
                return True
    if len(w) <= 5 or w[0] not in long:
        return False
    # two slips after the first letter of a long word; they change at most four of the letters that occur
    mine = letters(w)
    return any(abs(len(w) - len(c)) <= 2 and (mine ^ m).bit_count() <= 4 and edits(w, c, 2) <= 2 for c, m in long[w[0]])


@lru_cache(200_000)
def _near_common(w: str, common: frozenset[str]) -> bool:
    return _near(w, common, 4)


@lru_cache(200_000)
def _abbreviates(a: str, b: str) -> bool:
    """Whether ``a`` is a shortened ``b``: first letter and a subsequence of its letters."""
    if len(a) < 2 or len(a) >= len(b) or a[0] != b[0]:
        return False
    it = iter(b)
    return all(c in it for c in a)


@lru_cache(400_000)
def same_word(a: str, b: str) -> float:
    """1 for equal words, 0.9 for a slip of typing, 0.8 for an abbreviation, else 0."""
    if a == b:
        return 1.0
    short = min(len(a), len(b))
    if short == 1:
        return 0.8 if a[0] == b[0] else 0.0
    if short >= 4 and (sound(a) == sound(b) or edits(a, b, 2) <= (1 if short < 8 else 2)):
        return 0.9
    if _abbreviates(a, b) or _abbreviates(b, a):
        return 0.8
    if short == 3 and len(a) == len(b) and a[0] == b[0] and edits(a, b, 1) <= 1:
        return 0.7
    x, y = sorted((a, b), key=len)
    if len(x) >= 5 and any(_abbreviates(x[:i] + x[i + 1 :], y) for i in range(2, len(x))):
        return 0.7  # a shortened word with a slip
    if short >= 5 and edits(a, b, 2) <= 2 and a[0] == b[0]:
        return 0.7
    if 4 <= short < max(len(a), len(b)) and edits(min(a, b, key=len), max(a, b, key=len)[:short], 1) <= 1:
        return 0.7  # an abbreviation of a word with a slip
    return 0.0


#: Likeness of stems two slips apart.
TWO_SLIPS = 0.84


@lru_cache(400_000)
def same_stem(a: str, b: str) -> float:
    """1 for equal sound, less for each slip, 0 beyond two."""
    if a == b:
        return 1.0
    x, y = sound(a), sound(b)
    if x == y:
        return 0.98
    short = min(len(x), len(y))
    if short < 4:
        return 0.0
    d = min(edits(x, y, 2), edits(a, b, 2))
    if d == 1:
        return 0.92 if short >= 6 else 0.8
    if d == 2 and short >= 9 and jaro_winkler(a, b) >= 0.9:
        return TWO_SLIPS
    return 0.0


def compare_words(a: tuple[str, ...], b: tuple[str, ...]) -> tuple[float, int]:
    """Worst likeness over the words of the shorter list, 0 if one has no partner; words without a partner in the longer one."""
    if len(a) > len(b):
        a, b = b, a
    left, worst = list(b), 1.0
    for w in a:
        best = max(((same_word(w, x), k) for k, x in enumerate(left)), default=(0.0, -1))
        worst = min(worst, best[0])
        if best[0] == 0.0:
            return 0.0, len(left)
        left.pop(best[1])
    return worst, len(left)


def compare_orgs(a: tuple[str, tuple[str, ...], str], b: tuple[str, tuple[str, ...], str]) -> float:
    """Likeness of two parsed organisation names, 0 to 1; sister firms get 0."""
    st = same_stem(a[0], b[0])
    if st == 0.0:
        return 0.0
    words, extra = compare_words(a[1], b[1])
    if words == 0.0:
        return 0.0
    score = st * (0.9 + 0.1 * words)
    if not a[1] or not b[1]:
        score *= 0.75 if a[1] or b[1] else 1.0
    elif extra:
        score *= 0.88**extra
    if a[2] and b[2] and a[2] != b[2] and "co" not in (a[2], b[2]):
        score *= 0.88
    return score


# given forms, middle, surname, generation
Person = tuple[str, tuple[str, ...], str, str]


@lru_cache(200_000)
def _near_given(w: str, common: frozenset[str]) -> bool:
    return _near(w, common, 3) or "rn" in w and _near(w.replace("rn", "m"), common, 3)


GIVEN = frozenset(x for g, n in NICKNAMES.items() for x in (g, *n.split()))


def parse_person(name: str | None, common: frozenset[str] = GIVEN) -> Person | None:
    """Given name, middle names, surname and generation (``j``, ``s`` or empty).

    ``common`` has the given and middle names that are frequent in the corpus; the
    surname is what is neither one of them, nor a slip of one, nor an initial.
    Before a comma stands the surname.
    """
    s = unscan(fold(name))
    s = _PAREN.sub(" ", s)
    gen = ""
    parts: list[list[str]] = []
    head, _, tail = s.partition(",")
    for side in (head, tail):
        ws = []
        for w in re.sub(r"[^a-z0-9.'\- ]+", " ", side).replace(".", ". ").split():
            t = re.sub(r"['.-]", "", w)
            if not t or t in TITLES:
                continue
            if t in JUNIOR:
                gen = "j"
            elif t in SENIOR and t != "i":
                gen = "s"
            elif t not in OTHER_SUFFIX:
                ws.append(t)
        parts.append(ws)
    first, second = parts
    if first and second:
        return second[0], tuple(second[1:]), "".join(first), gen
    ws = first or second
    if not ws:
        return None
    if len(ws) == 1:
        return "", (), ws[0], gen
    kind = ["i" if len(w) == 1 else "c" if w in common or w in GIVEN or _canonical_given(w) else "n" if _near_given(w, common) else "u" for w in ws]
    if "u" not in kind:
        k = max((i for i, x in enumerate(kind) if x != "i"), key=lambda i: (kind[i] == "n", len(ws[i]), i), default=len(ws) - 1)
        kind[k] = "u"
    best, at = (0, 0), 0
    while at < len(ws):  # the longest run of unknown words
        end = at
        while end < len(ws) and kind[end] == "u":
            end += 1
        if end > at and sum(map(len, ws[at:end])) > sum(map(len, ws[best[0] : best[1]])):
            best = (at, end)
        at = max(end, at + 1)
    i, j = best
    # a surname cut by a space may begin or end like a given name
    if j < len(ws) and j > 1 and kind[j] == "n" and j == len(ws) - 1 and len("".join(ws[i:j])) < 7:
        j += 1
    if i > 1 and kind[i - 1] == "n" and len("".join(ws[i:j])) < 7:
        i -= 1
    rest = ws[:i] + ws[j:]
    return (rest[0] if rest else ""), tuple(rest[1:]), "".join(ws[i:j]), gen


_FORMS = [(s, letters(s), g) for g, ns in NICKNAMES.items() for n in (g, *ns.split()) if len(n) >= 4 for s in (sound(n),)]


@lru_cache(100_000)
def near_given(x: str) -> frozenset[str]:
    """Given names of which a form of four letters or more sounds like ``x`` but for one slip."""
    s = sound(x)
    mine = letters(s)
    return frozenset(g for f, m, g in _FORMS if abs(len(f) - len(s)) <= 1 and (mine ^ m).bit_count() <= 2 and edits(s, f, 1) <= 1)


@lru_cache(400_000)
def same_given(a: str, b: str) -> float:
    """1 for equal, 0.95 for nicknames, 0.9 for a slip, 0.7 for an initial, 0.5 if one is missing, else 0."""
    if not a or not b:
        return 0.5
    if a == b:
        return 1.0 if len(a) > 1 else 0.6
    ca, cb = _canonical_given(a), _canonical_given(b)
    if len(a) == 1 or len(b) == 1:
        i, other, canon = (a, b, cb) if len(a) == 1 else (b, a, ca)
        firsts = {other[0], sound(other)[:1], *(c[0] for c in canon)}
        return 0.7 if i in firsts or sound(i) in firsts or sound(i) in {sound(f) for f in firsts} else 0.0
    if ca & cb:
        return 0.95
    if sound(a) == sound(b):
        return 0.97
    d = min(edits(a, b, 2), edits(sound(a), sound(b), 2))
    if d == 1 and min(len(a), len(b)) >= 4 and not (a in GIVEN and b in GIVEN):
        return 0.9
    if d == 2 and min(len(a), len(b)) >= 7 and not (a in GIVEN and b in GIVEN):
        return 0.85
    if min(len(a), len(b)) >= 3 and max(len(a), len(b)) >= 4 and d <= 2 and a[0] == b[0] and not (a in GIVEN and b in GIVEN) and (d == 1 or len(a) > 5 and len(b) > 5):
        return 0.85
    for x, cs in ((a, cb), (b, ca)):  # a slip within another form of the same name
        if cs and not _canonical_given(x) and cs & near_given(x):
            return 0.85
    return 0.0


def same_middle(a: tuple[str, ...], b: tuple[str, ...]) -> float:
    """1 for equal, 0.8 if one is missing, 0.9 for initials and slips, 0 for different ones."""
    if not a or not b:
        return 0.8 if a or b else 0.9
    x, y = a[0], b[0]
    if x == y:
        return 1.0
    if len(x) == 1 or len(y) == 1:
        return 0.9 if sound(x)[:1] == sound(y)[:1] or x[0] == y[0] else 0.0
    return 0.95 if sound(x) == sound(y) or edits(x, y, 1) <= 1 else 0.0


def compare_persons(a: Person, b: Person) -> float:
    """Likeness of two parsed person names, 0 to 1; different given names of one family get 0."""
    st = same_stem(a[2], b[2])
    if st == 0.0:
        return 0.0
    g = same_given(a[0], b[0])
    m = same_middle(a[1], b[1])
    if g == 0.0 or m == 0.0:
        return 0.0
    gen = 1.0
    if a[3] and b[3] and a[3] != b[3]:
        return 0.0
    if a[3] != b[3]:
        gen = 0.8
    return st * (0.6 + 0.4 * g) * (0.8 + 0.2 * m) * gen


_MONTHS = {m: i for i, m in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split(), 1)}
Date = tuple[int, int, int]


def parse_date(s: str | None) -> tuple[Date, ...]:
    """Possible (year, month, day) of a date in one of several notations; 0 for a part not given; () for none.

    A slash date is day first or month first; the first of January and January alone
    stand for the year.
    """
    if not s:
        return ()
    t = s.strip().lower()
    if m := re.fullmatch(r"(\d{4})(?:-(\d{1,2}))?(?:-(\d{1,2}))?", t):
        y, mo, d = int(m[1]), int(m[2] or 0), int(m[3] or 0)
    elif m := re.fullmatch(r"(\d{1,2})[./](\d{1,2})[./](\d{4})", t):
        d, mo, y = int(m[1]), int(m[2]), int(m[3])
        if "/" in t and d <= 12 and mo <= 12 and d != mo and y:
            return ((y, mo, d), (y, d, mo))
        if mo > 12 >= d:
            d, mo = mo, d
    elif m := re.fullmatch(r"(\d{1,2})\.? ([a-z]{3})[a-z]*\.?,? (\d{4})", t):
        d, mo, y = int(m[1]), _MONTHS.get(m[2], 0), int(m[3])
    elif m := re.fullmatch(r"([a-z]{3})[a-z]*\.? (\d{1,2}),? (\d{4})", t):
        d, mo, y = int(m[2]), _MONTHS.get(m[1], 0), int(m[3])
    else:
        return ()
    if not 1000 < y < 3000 or mo > 12 or d > 31:
        return ()
    if (mo, d) in ((1, 1), (1, 0)):
        mo = d = 0
    return ((y, mo, d),)


def compare_dates(a: tuple[Date, ...], b: tuple[Date, ...]) -> int:
    """3 same day, 2 same at the coarser precision, 1 a slip away, 0 unknown, -1 different."""
    if not a or not b:
        return 0
    best = -1
    for x in a:
        for y in b:
            if x == y:
                best = max(best, 3 if x[2] else 2)
            elif x[0] == y[0] and (not x[1] or not y[1] or x[1] == y[1] and (not x[2] or not y[2])):
                best = max(best, 2)
            elif x[2] and y[2]:
                same = (x[0] == y[0]) + (x[1] == y[1]) + (x[2] == y[2])
                swapped = x[0] == y[0] and x[1] == y[2] and x[2] == y[1]
                if swapped or same == 2 and (x[0] != y[0] and sorted(str(x[0])) == sorted(str(y[0])) or x[0] == y[0]):
                    best = max(best, 1)
    return best


# Spellings of countries.
COUNTRIES = {
    "gb": "gb uk gbr greatbritain unitedkingdom england", "us": "us usa unitedstates america unitedstatesofamerica", "de": "de deu ger germany deutschland",
    "fr": "fr fra france", "it": "it ita italy italia", "es": "es esp spain espana", "nl": "nl nld netherlands thenetherlands holland nederland",
    "pl": "pl pol poland polska", "cy": "cy cyp cyprus", "vg": "vg vgb britishvirginislands", "pa": "pa pan panama", "ie": "ie irl ireland", "ch": "ch che switzerland schweiz suisse",
    "at": "at aut austria osterreich", "be": "be bel belgium belgique belgie", "lu": "lu lux luxembourg", "pt": "pt prt portugal", "se": "se swe sweden sverige", "no": "no nor norway norge",
    "dk": "dk dnk denmark danmark", "fi": "fi fin finland suomi", "cz": "cz cze czechia czechrepublic", "hu": "hu hun hungary", "ro": "ro rou romania", "bg": "bg bgr bulgaria", "gr": "gr grc greece",
    "ru": "ru rus russia russianfederation", "ua": "ua ukr ukraine", "by": "by blr belarus", "tr": "tr tur turkey turkiye", "ae": "ae are unitedarabemirates uae", "sg": "sg sgp singapore",
    "hk": "hk hkg hongkong", "cn": "cn chn china", "jp": "jp jpn japan", "in": "in ind india", "au": "au aus australia", "ca": "ca can canada", "br": "br bra brazil brasil", "mx": "mx mex mexico",
    "za": "za zaf southafrica", "mt": "mt mlt malta", "li": "li lie liechtenstein", "ee": "ee est estonia", "lv": "lv lva latvia", "lt": "lt ltu lithuania", "sk": "sk svk slovakia", "si": "si svn slovenia", "hr": "hr hrv croatia",
}
_COUNTRY = {x: c for c, xs in COUNTRIES.items() for x in xs.split()}


def parse_country(s: str | None) -> str:
    """Two-letter code of a country or jurisdiction in one of several notations; one that is not listed stays as its letters, empty if there are none."""
    t = re.sub(r"[^a-z_]", "", fold(s))
    first = t.partition("_")[0]
    return _COUNTRY.get(t) or _COUNTRY.get(first) or first


def one_country(a: str, b: str) -> bool:
    """Whether two parsed countries can be one: notations of different length cannot be told apart where one is not listed."""
    return a == b or len(a) != len(b)
