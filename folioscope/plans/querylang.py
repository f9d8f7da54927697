"""The query language: what was typed becomes a small tree of phrases.

A query is a conjunction of groups, each a disjunction of phrases, with excluded phrases.  The box
takes "quoted phrases", -exclusions (after white space) and words; words gain their spelling variants
and, unless it is switched off, Turkish ones are read in English.  The fields all, phrase, any and none add to it.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from folioscope.functions.analysis import ASCII_WORD_PATTERN, FOLD_FROM, FOLD_TO, WORD_CHARS, WORD_PATTERN, python_terms

# Groups of equivalent spellings.
VARIANTS = (
    ("rebate", "rabbet"), ("mitre", "miter"), ("mortise", "mortice"), ("moulding", "molding"), ("bandsaw", "band saw"),
    ("tablesaw", "table saw"), ("halfblind", "half blind"), ("drawbore", "draw bore"), ("freehand", "free hand"), ("handheld", "hand held"),
    ("center", "centre"), ("plough", "plow"), ("grey", "gray"), ("colour", "color"), ("aluminium", "aluminum"),
    ("fibre", "fiber"), ("metre", "meter"), ("jewellery", "jewelry"), ("catalogue", "catalog"), ("draught", "draft"),
)

# Turkish terms that are replaced by English words before a query is cut into words.
SEEDS = (
    ("kırlangıç kuyruğu", "dovetail"), ("kirlangic kuyrugu", "dovetail"), ("kırlangıçkuyruğu", "dovetail"), ("zıvana", "tenon mortise"), ("zivana", "tenon mortise"),
    ("gönye", "miter"), ("gonye", "miter"), ("zımpara", "sandpaper"), ("zimpara", "sandpaper"), ("yapıştırıcı", "glue"), ("yapistirici", "glue"),
    ("çekmece", "drawer"), ("cekmece", "drawer"), ("menteşe", "hinge"), ("mentese", "hinge"), ("marangozluk", "woodworking"), ("marangoz", "woodworking"),
    ("çerçeve", "frame"), ("cerceve", "frame"), ("çekiç", "hammer"), ("cekic", "hammer"), ("testere", "saw"), ("sandalye", "chair"), ("sandık", "chest"),
    ("sandik", "chest"), ("ahşap", "wood"), ("ahsap", "wood"), ("vernik", "varnish"), ("dolap", "cabinet"), ("tezgah", "bench"), ("pencere", "window"),
    ("tabure", "stool"), ("tutkal", "glue"), ("yüzey", "surface"), ("yuzey", "surface"), ("kapı", "door"), ("kapi", "door"), ("masa", "table"), ("cila", "finish polish"),
)

# Readings of Turkish words.
DICTIONARY = (
    ("testere", ["saw"]), ("bant testere", ["band saw"]), ("daire testere", ["circular saw"]), ("el testere", ["hand saw"]), ("testere diski", ["saw blade"]), ("zincir testere", ["chain saw"]),
    ("keski", ["chisel"]), ("balta", ["axe"]), ("kazma", ["adze"]), ("kumpas", ["caliper", "vernier caliper"]), ("cetvel", ["ruler", "rule"]), ("gönye", ["miter", "square"]),
    ("su terazisi", ["spirit level"]), ("pervaz", ["jig"]), ("kalip", ["template"]), ("bant", ["tape measure"]), ("vida", ["screw"]), ("vidalar", ["screw"]), ("vida agzi", ["screwdriver"]),
    ("bulon", ["bolt"]), ("percin", ["rivet"]), ("somun", ["nut"]), ("kose", ["bracket"]), ("menteşe", ["hinge"]), ("ray", ["rail"]), ("cekic", ["hammer"]), ("pense", ["pliers"]),
    ("makas", ["shears", "scissors"]), ("anahtar", ["wrench", "spanner"]), ("tornavida", ["screwdriver"]), ("rende", ["plane"]), ("duzlem", ["plane"]), ("kaziyici", ["chisel"]),
    ("zirh", ["rasp", "file"]), ("ege", ["rasp"]), ("zimpara", ["sandpaper"]), ("zımpara", ["sandpaper"]), ("zımpara kâğıdı", ["sandpaper"]), ("kum", ["sand"]), ("taşlama", ["grinding"]),
    ("taslama", ["grinding"]), ("cila", ["polish"]), ("cıla", ["polish"]), ("boya", ["paint"]), ("vernik", ["varnish"]), ("lak", ["lacquer"]), ("mum", ["wax"]), ("balmum", ["beeswax"]),
    ("yağ", ["oil"]), ("macun", ["paste"]), ("dolgu", ["filler"]), ("zivana", ["tenon", "mortise"]), ("zıvana", ["tenon", "mortise"]), ("gecme", ["tenon joint"]),
    ("kirlangic kuyrugu", ["dovetail"]), ("kırlangıç kuyruğu", ["dovetail"]), ("gezmeli", ["mortise"]), ("mahfaza", ["housing"]), ("kazik", ["mortise"]), ("sokma", ["mortise"]),
    ("yapistirma", ["glued joint"]), ("yapıştırma", ["glued joint"]), ("tırtıklı", ["finger joint"]), ("tirtikli", ["finger joint"]), ("torna", ["lathe"]), ("planya", ["planer"]),
    ("freze", ["router"]), ("matkap", ["drill"]), ("burgu", ["drill bit"]), ("vida takimi", ["drill"]), ("dikis", ["sander"]), ("kutup", ["sander"]), ("ahsap", ["wood"]), ("ahşap", ["wood"]),
    ("orman", ["wood"]), ("mese", ["oak"]), ("meşe", ["oak"]), ("kayin", ["beech"]), ("kayın", ["beech"]), ("disbudak", ["ash"]), ("dişbudak", ["ash"]), ("akcaagac", ["maple"]),
    ("akçaağaç", ["maple"]), ("ceviz", ["walnut"]), ("saricam", ["pine"]), ("sarıçam", ["pine"]), ("ladin", ["spruce"]), ("kavak", ["poplar"]), ("ihlamzur", ["basswood", "linden"]),
    ("mantar", ["mushroom rot"]), ("budak", ["knot"]), ("budakli", ["knotty"]), ("life", ["veneer"]), ("kalinti", ["sapwood"]), ("kabuk", ["bark"]), ("masa", ["table"]), ("masasi", ["table"]),
    ("sandalye", ["chair"]), ("dolap", ["cabinet", "cupboard"]), ("raf", ["shelf"]), ("kutuyu", ["box"]), ("kutu", ["box"]), ("sandik", ["chest"]), ("sandık", ["chest"]),
    ("pencere", ["window"]), ("kapi", ["door"]), ("kapı", ["door"]), ("tezgah", ["bench", "workbench"]), ("tezgâh", ["bench", "workbench"]), ("marangozluk", ["woodworking"]),
    ("marangoz", ["woodworker"]), ("cila makinesi", ["polisher"]), ("parlaklik", ["gloss"]), ("parlaklık", ["gloss"]), ("mat", ["matte"]), ("puruzluluk", ["roughness"]),
    ("pürüzlülük", ["roughness"]), ("duzgunluk", ["smoothness"]), ("düzgünlük", ["smoothness"]), ("catlak", ["crack"]), ("çatlak", ["crack"]), ("oluk", ["groove"]), ("pah", ["chamfer"]),
    ("kenar", ["edge"]), ("yuzey", ["surface"]), ("yüzey", ["surface"]), ("doku", ["grain", "figure"]), ("burat", ["wormhole"]), ("kurt", ["worm"]), ("esme", ["warp"]),
    ("bucurme", ["winding"]), ("toklama", ["pounding"]), ("kesmek", ["cut"]), ("kesme", ["cutting"]), ("oymak", ["carve"]), ("oyma", ["carving"]), ("zimbalamak", ["plane"]),
    ("zımparalamak", ["sand"]), ("yapistirmak", ["glue"]), ("yapıştırmak", ["glue"]), ("tutmak", ["clamp", "hold"]), ("tutma", ["clamp", "hold"]), ("tutulur", ["hold"]),
    ("tutulması", ["hold"]), ("sikmak", ["tighten"]), ("sikilir", ["tighten"]), ("sikma", ["tighten"]), ("gevsetmek", ["loosen"]), ("çekmek", ["pull"]), ("vurmak", ["strike"]),
    ("dikmek", ["join"]), ("baglamak", ["clamp"]), ("sacmak", ["dress"]), ("şaplamak", ["dress"]), ("yapmak", ["make"]), ("olmak", []), ("takmak", ["attach"]), ("sökmek", ["remove"]),
    ("cikarmak", ["remove"]), ("olcemek", ["measure"]), ("ölçmek", ["measure"]), ("bilemek", ["sharpen"]), ("bileme", ["sharpening"]), ("keskin", ["sharp"]), ("keskinlik", ["sharpness"]),
    ("kore", ["sharp"]), ("bileyik", ["whetstone"]), ("tasin", ["whetstone"]), ("tas", ["stone"]), ("rendelemek", ["planing"]), ("rendeleme", ["planing"]), ("zimbalamak", ["planing"]),
    ("bilegen", ["planer", "thickness planer"]), ("kazima", ["scraping"]), ("kaziyici", ["chisel"]), ("kart kazima", ["card scraper"]), ("kart", ["card"]), ("tabla", ["tabletop", "top"]),
    ("tablasi", ["tabletop", "top"]), ("kesim", ["cut"]), ("kesisi", ["cut"]), ("yuzeyi", ["surface"]), ("tutkal", ["glue"]), ("yapistirici", ["glue"]), ("epoxy", ["epoxy"]),
    ("epoksi", ["epoxy"]), ("beyaz tutkal", ["glue"]), ("kestirme", ["cut", "miter"]), ("planye", ["planer"]), ("kazma", ["adze"]), ("çerçeve", ["frame"]), ("çekmece", ["drawer"]),
    ("çıtalı", ["beadboard"]), ("kasa", ["carcass"]), ("gövde", ["carcass"]), ("kızak", ["slide"]), ("misket", ["dowel"]), ("kazıklı", ["doweled"]), ("zıvana bıçak", ["tenon saw"]),
)

# Words of grammar, folded, and endings that may follow a known stem, folded.
FUNCTION_WORDS = frozenset(
    "nasil neden niye ne nedir hangi nerede kim kimi kime ile icin ve ya da de ki mi mu bir iki cok az daha en fazla olur olmak oldu var yok yapilir eder etmek boyle soyle".split()
)
ENDINGS = ("larn", "lerin", "lar", "ler", "nin", "nun", "in", "un", "da", "de", "ta", "te", "ya", "ye", "si", "ni", "nu", "ci", "li", "lu", "ma", "me", "a", "e", "i", "u")

_FOLD = str.maketrans(FOLD_FROM, FOLD_TO)
#: Letters and digits that may not stand beside a seed.
_LETTERS = "0-9A-Za-zÇĞİÖŞÜçğıöşü"
_WORD = re.compile(WORD_PATTERN)
_ASCII_WORD = re.compile(ASCII_WORD_PATTERN)


def fold(s: str) -> str:
    return s.translate(_FOLD).lower()


#: Folded words and their readings; the dictionary goes before the seeds.
READINGS = {fold(word): tuple(english.split()) for word, english in reversed(SEEDS)} | {fold(word): tuple(found) for word, found in DICTIONARY}


@dataclass(frozen=True)
class Term:
    """One thing asked for: its equivalent spellings, whether it was quoted or excluded, what was typed."""

    spellings: tuple[str, ...]
    kind: str = "text"
    typed: str = ""


@dataclass(frozen=True)
class Query:
    """Conjunction of groups of alternative phrases, and phrases that must not occur."""

    groups: tuple[tuple[str, ...], ...]
    excluded: tuple[str, ...] = ()
    terms: tuple[Term, ...] = field(default=(), compare=False)

    def text(self) -> str:
        """The query as a match expression, to show it."""
        quote = lambda p: '"' + p.replace('"', "") + '"'
        parts = [quote(g[0]) if len(g) == 1 else "(" + " OR ".join(map(quote, g)) + ")" for g in self.groups]
        return " AND ".join(parts) + "".join(f" NOT {quote(p)}" for p in self.excluded)


@dataclass(frozen=True)
class Lexicon:
    """Spelling groups and, for translation, readings; both may be replaced by a library's own."""

    variants: tuple[tuple[str, ...], ...] = VARIANTS
    readings: dict[str, tuple[str, ...]] = field(default_factory=lambda: dict(READINGS))
    seeds: tuple[tuple[str, str], ...] = SEEDS
    translate: bool = True

    def pieces(self, text: str) -> list[tuple[str, str | None]]:
        """The text in order, cut at seeds, the longest first: what is read, and the seed as typed."""
        if not self.translate or not self.seeds:
            return [(text, None)]
        english = {fold(word): found for word, found in self.seeds}
        whole = re.compile(f"(?<![{_LETTERS}])({'|'.join(re.escape(w) for w, _ in sorted(self.seeds, key=lambda x: -len(x[0])))})(?![{_LETTERS}])", re.I)
        cut = whole.split(text)
        return [(english.get(fold(x), x), x) if k % 2 else (x, None) for k, x in enumerate(cut)]

    def others(self, phrase: str) -> tuple[str, ...]:
        key = fold(phrase.strip())
        return tuple(sorted({fold(w) for g in self.variants if key in {fold(x) for x in g} for w in g} - {key}))

    def reading(self, word: str) -> tuple[str, ...] | None:
        """Readings of a word: exact, then without an ending, then by the longest key that begins it.

        None if the word isn't known, () if it is a word of grammar.
        """
        key = fold(word)
        if key in FUNCTION_WORDS:
            return ()
        if key in self.readings:
            return self.readings[key]
        for end in ENDINGS:
            if key.endswith(end) and len(key) - len(end) >= 4 and key[: -len(end)] in self.readings:
                return self.readings[key[: -len(end)]]
        known = [k for k in self.readings if 4 <= len(k) <= len(key) <= len(k) + 10 and key.startswith(k)]
        return self.readings[max(known, key=len)] if known and len(key) >= 5 else None


def _split(text: str, lexicon: Lexicon) -> list[Term]:
    """Words of the box with their spellings; seeds give the words that they stand for, and grammar nothing."""
    out = []
    for piece, seed in lexicon.pieces(text):
        for m in _WORD.finditer(piece):
            word = m.group()
            reading = lexicon.reading(word) if lexicon.translate else None
            if reading is None:
                out.append(Term((word, *lexicon.others(word)), "text", seed or word))
            elif reading:
                out.append(Term(tuple(dict.fromkeys(reading)), "text", seed or word))
    return out


def understand(q: str, lexicon: Lexicon | None = None) -> list[Term]:
    """Phrases as typed, then exclusions, then words."""
    lexicon = lexicon or Lexicon()
    quoted = re.findall(r'"([^"]+)"', q)
    rest = re.sub(r'"[^"]+"', " ", q)
    minus = re.compile(rf"(?:(?<=\s)|^)-([{WORD_CHARS}][\w\-]*)")
    excluded = minus.findall(rest)
    out = [Term((p,), "phrase", p) for p in quoted] + [Term((w,), "excluded", w) for w in excluded]
    return out + _split(minus.sub(" ", rest), lexicon)


def parse(q: str = "", all_words: str = "", phrase: str = "", any_words: str = "", none_words: str = "", lexicon: Lexicon | None = None, analyser: str = "simple") -> Query | None:
    """The query tree; None if nothing positive is asked for."""
    terms = understand(q, lexicon)
    groups = [t.spellings for t in terms if t.kind != "excluded"]
    groups += [(w,) for w in _ASCII_WORD.findall(all_words)]
    if phrase.strip():
        groups.append((phrase.replace('"', "").strip(),))
    if any_of := tuple(_ASCII_WORD.findall(any_words)):
        groups.append(any_of)
    if not groups:
        return None
    excluded = [t.spellings[0] for t in terms if t.kind == "excluded"] + _ASCII_WORD.findall(none_words)
    return Query(tuple(groups), tuple(p for p in dict.fromkeys(excluded) if python_terms(p, analyser)), tuple(terms))


def expanded(raw: str, any_mode: bool = False, lexicon: Lexicon | None = None) -> Query | None:
    """The query of the topic surfaces: phrases gain variants too, and nothing is excluded."""
    lexicon = lexicon or Lexicon()
    quoted = re.findall(r'"([^"]+)"', raw)
    groups = [(p, *lexicon.others(p)) for p in quoted]
    groups += [t.spellings for t in _split(re.sub(r'"[^"]+"', " ", raw), lexicon)]
    if not groups:
        return None
    return Query((tuple(dict.fromkeys(p for g in groups for p in g)),)) if any_mode else Query(tuple(groups))


def simple(raw: str, any_mode: bool = False) -> Query | None:
    """Phrases and ASCII words without expansion."""
    groups = [(p,) for p in re.findall(r'"([^"]+)"', raw)] + [(w,) for w in _ASCII_WORD.findall(re.sub(r'"[^"]+"', " ", raw))]
    if not groups:
        return None
    return Query((tuple(p for g in groups for p in g),)) if any_mode else Query(tuple(groups))


def describe(q: str, lexicon: Lexicon | None = None) -> list[list[str]]:
    """What was rewritten: [typed, what is searched for...], each typed form once."""
    read: dict[str, tuple[str, list[str]]] = {}
    for t in understand(q, lexicon):
        if t.kind == "text":
            read.setdefault(fold(t.typed), (t.typed, []))[1].extend(t.spellings)
    out = []
    for key, (typed, found) in read.items():
        others = [x for x in dict.fromkeys(found) if fold(x) != key]
        if others:
            out.append([typed, *others])
    return out


def semantic_text(q: str, lexicon: Lexicon | None = None) -> str:
    """What the vector side is asked: the first spelling of each word, or all that was typed."""
    return " ".join(t.spellings[0] for t in understand(q, lexicon) if t.kind == "text") or q
