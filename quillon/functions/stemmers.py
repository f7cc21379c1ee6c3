"""Stemmers of seven languages by the published Snowball algorithms.

A stemmer takes suffixes off a lower-case word, each only within a region of it: R1 begins after the first consonant that
follows a vowel, R2 likewise within R1, and RV depends on the language. Regions are places in the word as it was at first.
"""

from __future__ import annotations

from collections.abc import Callable


def _regions(w: str, vowels: str) -> tuple[int, int]:
    """Where R1 and R2 begin; the word's length if they are empty."""
    found = []
    at = 0
    for _ in range(2):
        i = at
        while i < len(w) and w[i] not in vowels:
            i += 1
        while i < len(w) and w[i] in vowels:
            i += 1
        at = min(len(w), i + 1) if i < len(w) else len(w)
        found.append(at)
    return found[0], found[1]


def _rv(w: str, vowels: str) -> int:
    """RV of Spanish, Italian and Portuguese."""
    if len(w) < 3:
        return len(w)
    if w[1] not in vowels:
        return next((i + 1 for i in range(2, len(w)) if w[i] in vowels), len(w))
    if w[0] in vowels:
        return next((i + 1 for i in range(2, len(w)) if w[i] not in vowels), len(w))
    return 3


def _by_length(*groups: str) -> list[tuple[str, int]]:
    """(suffix, number of its group), longest first."""
    return sorted(((s, i) for i, g in enumerate(groups) for s in g.split()), key=lambda x: -len(x[0]))


def _ending(w: str, suffixes: list[tuple[str, int]], start: int = 0) -> tuple[str, int]:
    """The longest suffix that w has from start on, with its group; ("", -1) if none."""
    return next(((s, g) for s, g in suffixes if len(w) - len(s) >= start and w.endswith(s)), ("", -1))


def _cut(w: str, suffix: str, start: int, new: str = "") -> str:
    """w with suffix, if it has that and it lies from start on, replaced."""
    return w[: len(w) - len(suffix)] + new if w.endswith(suffix) and len(w) - len(suffix) >= start else w


# English

_EN_V = "aeiouy"
_EN_WHOLE = dict(x.split(":") for x in "skis:ski skies:sky dying:die lying:lie tying:tie idly:idl gently:gentl ugly:ugli early:earli only:onli singly:singl".split()) | {x: x for x in "sky news howe atlas cosmos bias andes".split()}
_EN_KEPT = frozenset("inning outing canning herring earring proceed exceed succeed".split())
_EN_2 = sorted([("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("abli", "able"), ("entli", "ent"), ("izer", "ize"), ("ization", "ize"), ("ational", "ate"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("aliti", "al"), ("alli", "al"), ("fulness", "ful"), ("ousli", "ous"), ("ousness", "ous"), ("iveness", "ive"), ("iviti", "ive"), ("biliti", "ble"), ("bli", "ble"), ("ogi", "og"), ("fulli", "ful"), ("lessli", "less"), ("li", "")], key=lambda x: -len(x[0]))
_EN_3 = sorted([("tional", "tion"), ("ational", "ate"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""), ("ative", "")], key=lambda x: -len(x[0]))
_EN_4 = _by_length("al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize ion")


def _en_short(w: str) -> bool:
    """Whether w ends in a short syllable."""
    if len(w) == 2:
        return w[0] in _EN_V and w[1] not in _EN_V
    return len(w) > 2 and w[-1] not in _EN_V + "wxY" and w[-2] in _EN_V and w[-3] not in _EN_V


def english(word: str) -> str:
    if len(word) <= 2:
        return word
    if word in _EN_WHOLE:
        return _EN_WHOLE[word]
    w = "".join("Y" if c == "y" and (i == 0 or word[i - 1] in _EN_V) else c for i, c in enumerate(word))
    r1, r2 = _regions(w, _EN_V)
    for start in ("gener", "commun", "arsen"):
        if w.startswith(start):
            r1 = len(start)
            r2 = r1 + _regions(w[r1:], _EN_V)[0]
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and any(c in _EN_V for c in w[:-2]):
        w = w[:-1]
    if w in _EN_KEPT:
        return w
    for end in ("eedly", "ingly", "edly", "eed", "ing", "ed"):
        if w.endswith(end):
            stem = w[: -len(end)]
            if end.startswith("eed"):
                w = stem + "ee" if len(stem) >= r1 else w
            elif any(c in _EN_V for c in stem):
                w = stem
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif w.endswith(("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")):
                    w = w[:-1]
                elif _en_short(w) and r1 >= len(w):
                    w += "e"
            break
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in _EN_V:
        w = w[:-1] + "i"
    for end, new in _EN_2:
        if w.endswith(end):
            stem = w[: -len(end)]
            if len(stem) >= r1 and (end != "ogi" or stem.endswith("l")) and (end != "li" or stem[-1:] in "cdeghkmnrt"):
                w = stem + new
            break
    for end, new in _EN_3:
        if w.endswith(end):
            if len(w) - len(end) >= (r2 if end == "ative" else r1):
                w = w[: -len(end)] + new
            break
    end, _ = _ending(w, _EN_4)
    if end and len(w) - len(end) >= r2 and (end != "ion" or w[:-3].endswith(("s", "t"))):
        w = w[: -len(end)]
    if w.endswith("e") and (len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not _en_short(w[:-1]))):
        w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.lower()


# German

_DE_V = "aeiouyäöü"
_DE_1 = _by_length("em ern er", "e en es", "s")
_DE_2 = _by_length("en er est", "st")
_DE_3 = _by_length("end ung", "ig ik isch", "lich heit", "keit")


def _between(word: str, letters: str, vowels: str) -> str:
    """word with those letters between vowels in upper case, so that they are no vowels."""
    w = list(word)
    for i in range(1, len(w) - 1):
        if w[i] in letters and w[i - 1] in vowels and w[i + 1] in vowels:
            w[i] = w[i].upper()
    return "".join(w)


def german(word: str) -> str:
    w = _between(word.replace("ß", "ss"), "uy", _DE_V)
    r1, r2 = _regions(w, _DE_V)
    r1 = max(r1, min(3, len(w)))
    end, group = _ending(w, _DE_1)
    stem = w[: len(w) - len(end)]
    if end and len(stem) >= r1:
        if group < 2:
            w = stem[:-1] if group == 1 and stem.endswith("niss") else stem
        elif stem[-1:] in tuple("bdfghklmnrt"):
            w = stem
    end, group = _ending(w, _DE_2)
    stem = w[: len(w) - len(end)]
    if end and len(stem) >= r1 and (group == 0 or (len(stem) > 3 and stem[-1] in "bdfghklmnt")):
        w = stem
    end, group = _ending(w, _DE_3)
    stem = w[: len(w) - len(end)]
    if end and len(stem) >= r2:
        if group == 0:
            w = stem
            if w.endswith("ig") and not w.endswith("eig"):
                w = _cut(w, "ig", r2)
        elif group == 1:
            w = w if stem.endswith("e") else stem
        elif group == 2:
            w = _cut(stem, "er" if stem.endswith("er") else "en", r1)
        else:
            w = _cut(stem, "lich" if stem.endswith("lich") else "ig", r2)
    return w.lower().translate(str.maketrans("äöü", "aou"))


# French

_FR_V = "aeiouyâàëéêèïîôûù"
_FR_1 = _by_length(
    "ance iqUe isme able iste eux ances iqUes ismes ables istes", "atrice ateur ation atrices ateurs ations", "logie logies", "usion ution usions utions", "ence ences", "ement ements", "ité ités", "if ive ifs ives", "eaux", "aux", "euse euses", "issement issements", "amment", "emment", "ment ments"
)
_FR_2A = _by_length("îmes ît îtes i ie ies ir ira irai iraIent irais irait iras irent irez iriez irions irons iront is issaIent issais issait issant issante issantes issants isse issent isses issez issiez issions issons it")
_FR_2B = _by_length("ions", "é ée ées és èrent er era erai eraIent erais erait eras erez eriez erions erons eront ez iez", "âmes ât âtes a ai aIent ais ait ant ante antes ants as asse assent asses assiez assions")
_FR_4 = _by_length("ion", "ier ière Ier Ière", "e", "ë")


def _fr_standard(w: str, r1: int, r2: int, rv: int) -> tuple[str, bool]:
    """(w after the first step, whether the verbs' step is left out)."""
    end, group = _ending(w, _FR_1)
    if not end:
        return w, False
    stem = w[: len(w) - len(end)]
    n = len(stem)
    if group in (0, 1, 2, 3, 4, 6, 7) and n < r2:
        return w, False
    if group == 0:
        return stem, True
    if group == 1:
        return (_cut(stem, "ic", r2) if not stem.endswith("ic") or n - 2 >= r2 else stem[:-2] + "iqU"), True
    if group in (2, 3, 4):
        return stem + {2: "log", 3: "u", 4: "ent"}[group], True
    if group == 5:
        if n < rv:
            return w, False
        if stem.endswith("iv"):
            cut = _cut(stem, "iv", r2)
            return (_cut(cut, "at", r2) if cut != stem else cut), True
        if stem.endswith("eus"):
            return (stem[:-3] if n - 3 >= r2 else stem[:-3] + "eux" if n - 3 >= r1 else stem), True
        if stem.endswith(("abl", "iqU")):
            return (stem[:-3] if n - 3 >= r2 else stem), True
        if stem.endswith(("ièr", "Ièr")):
            return (stem[:-3] + "i" if n - 3 >= rv else stem), True
        return stem, True
    if group == 6:
        if stem.endswith("abil"):
            return (stem[:-4] if n - 4 >= r2 else stem[:-4] + "abl"), True
        if stem.endswith("ic"):
            return (stem[:-2] if n - 2 >= r2 else stem[:-2] + "iqU"), True
        return _cut(stem, "iv", r2), True
    if group == 7:
        cut = _cut(stem, "at", r2)
        if cut != stem and cut.endswith("ic"):
            cut = cut[:-2] if len(cut) - 2 >= r2 else cut[:-2] + "iqU"
        return cut, True
    if group == 8:
        return stem + "eau", True
    if group == 9:
        return (stem + "al", True) if n >= r1 else (w, False)
    if group == 10:
        return (stem, True) if n >= r2 else (stem + "eux", True) if n >= r1 else (w, False)
    if group == 11:
        return (stem, True) if n >= r1 and stem[-1:] and stem[-1] not in _FR_V else (w, False)
    if group in (12, 13):
        return (stem + ("ant" if group == 12 else "ent") if n >= rv else w), False
    return (stem if stem[-1:] and stem[-1] in _FR_V and n - 1 >= rv else w), False


def french(word: str) -> str:
    w = list(word)
    for i, c in enumerate(word):
        before, after = i > 0 and w[i - 1] in _FR_V, i + 1 < len(word) and word[i + 1] in _FR_V
        if (c in "ui" and before and after) or (c == "y" and (before or after)) or (c == "u" and i and word[i - 1] == "q"):
            w[i] = c.upper()
    w = "".join(w)
    r1, r2 = _regions(w, _FR_V)
    if w[:3] in ("par", "col", "tap"):
        rv = 3
    elif len(w) > 1 and w[0] in _FR_V and w[1] in _FR_V:
        rv = min(3, len(w))
    else:
        rv = next((i + 1 for i in range(1, len(w)) if w[i] in _FR_V), len(w))
    first = w
    w, done = _fr_standard(w, r1, r2, rv)
    if not done:
        before = w
        end, _ = _ending(w, _FR_2A, rv)
        at = len(w) - len(end) - 1
        if end and at >= rv and w[at] not in _FR_V:
            w = w[: at + 1]
        if w == before:
            end, group = _ending(w, _FR_2B, rv)
            stem = w[: len(w) - len(end)]
            if group == 0:
                w = stem if len(stem) >= r2 else w
            elif end:
                w = _cut(stem, "e", rv) if group == 2 else stem
    if w != first:
        w = w[:-1] + "i" if w.endswith("Y") else w[:-1] + "c" if w.endswith("ç") else w
    else:
        if len(w) > 1 and w.endswith("s") and w[-2] not in "aiouès":
            w = w[:-1]
        end, group = _ending(w, _FR_4, rv)
        stem = w[: len(w) - len(end)]
        if group == 0:
            if len(stem) >= r2 and len(stem) - 1 >= rv and stem.endswith(("s", "t")):
                w = stem
        elif group == 1:
            w = stem + "i"
        elif group == 2 or (group == 3 and stem.endswith("gu")):
            w = stem
    if w.endswith(("enn", "onn", "ett", "ell", "eill")):
        w = w[:-1]
    i = len(w)
    while i > 0 and w[i - 1] not in _FR_V:
        i -= 1
    if 0 < i < len(w) and w[i - 1] in "éè":
        w = w[: i - 1] + "e" + w[i:]
    return w.lower()


# Spanish, Italian, Portuguese

_ACUTE = str.maketrans("áéíóú", "aeiou")
_ES_V = "aeiouáéíóúü"
_ES_0 = _by_length("me se sela selo selas selos la le lo las les los nos")
_ES_0B = _by_length("iéndo ándo ár ér ír", "ando iendo ar er ir", "yendo")
_ES_1 = _by_length(
    "anza anzas ico ica icos icas ismo ismos able ables ible ibles ista istas oso osa osos osas amiento amientos imiento imientos",
    "adora ador ación adoras adores aciones ante antes ancia ancias", "logía logías", "ución uciones", "encia encias", "amente", "mente", "idad idades", "iva ivo ivas ivos",
)
_ES_2A = _by_length("ya ye yan yen yeron yendo yo yó yas yes yais yamos")
_ES_2B = _by_length(
    "en es éis emos",
    "arían arías arán arás aríais aría aréis aríamos aremos ará aré erían erías erán erás eríais ería eréis eríamos eremos erá eré irían irías irán irás iríais iría iréis iríamos iremos irá iré aba ada ida ía ara iera ad ed id ase iese aste iste an aban ían aran ieran asen iesen aron ieron ado ido ando iendo ió ar er ir as abas adas idas ías aras ieras ases ieses ís áis abais íais arais ierais aseis ieseis asteis isteis ados idos amos ábamos íamos imos áramos iéramos iésemos ásemos",
)
_ES_3 = _by_length("os a o á í ó", "e é")


def _adverb(stem: str, r2: int, second: tuple[str, ...]) -> str:
    """What is left of a stem before -amente."""
    if stem.endswith("iv"):
        cut = _cut(stem, "iv", r2)
        return _cut(cut, "at", r2) if cut != stem else cut
    return _first_cut(stem, second, r2)


def _first_cut(stem: str, ends: tuple[str, ...], start: int) -> str:
    return next((_cut(stem, e, start) for e in sorted(ends, key=len, reverse=True) if stem.endswith(e)), stem)


def spanish(word: str) -> str:
    w = word
    r1, r2 = _regions(w, _ES_V)
    rv = _rv(w, _ES_V)
    end, _ = _ending(w, _ES_0)
    if end:
        stem = w[: len(w) - len(end)]
        before, group = _ending(stem, _ES_0B, rv)
        if group == 0:
            w = stem[: len(stem) - len(before)] + before.translate(_ACUTE)
        elif group == 1 or (group == 2 and stem[: len(stem) - 5].endswith("u")):
            w = stem
    first = w
    end, group = _ending(w, _ES_1)
    stem = w[: len(w) - len(end)]
    if end and len(stem) >= (r1 if group == 5 else r2):
        if group == 0:
            w = stem
        elif group == 1:
            w = _cut(stem, "ic", r2)
        elif group < 5:
            w = stem + ("log", "u", "ente")[group - 2]
        elif group == 5:
            w = _adverb(stem, r2, ("os", "ic", "ad"))
        else:
            w = _first_cut(stem, (("ante", "able", "ible"), ("abil", "ic", "iv"), ("at",))[group - 6], r2)
    if w == first:
        end, _ = _ending(w, _ES_2A, rv)
        if end and w[: len(w) - len(end)].endswith("u"):
            w = w[: len(w) - len(end)]
        else:
            end, group = _ending(w, _ES_2B, rv)
            if end:
                w = w[: len(w) - len(end)]
                w = w[:-1] if group == 0 and w.endswith("gu") else w
    end, group = _ending(w, _ES_3, rv)
    if end:
        w = w[: len(w) - len(end)]
        if group == 1 and w.endswith("gu") and len(w) - 1 >= rv:
            w = w[:-1]
    return w.translate(_ACUTE)


_IT_V = "aeiouàèìòù"
_IT_0 = _by_length("ci gli la le li lo mi ne si ti vi sene gliela gliele glieli glielo gliene mela mele meli melo mene tela tele teli telo tene cela cele celi celo cene vela vele veli velo vene")
_IT_1 = _by_length(
    "anza anze ico ici ica ice iche ichi ismo ismi abile abili ibile ibili ista iste isti istà istè istì oso osi osa ose mente atrice atrici ante anti",
    "azione azioni atore atori", "logia logie", "uzione uzioni usione usioni", "enza enze", "amento amenti imento imenti", "amente", "ità", "ivo ivi iva ive",
)
_IT_2 = _by_length(
    "ammo ando ano are arono asse assero assi assimo ata ate ati ato ava avamo avano avate avi avo emmo enda ende endi endo erà erai eranno ere erebbe erebbero erei eremmo eremo ereste eresti erete erò erono essero ete eva evamo evano evate evi evo Yamo iamo immo irà irai iranno ire irebbe irebbero irei iremmo iremo ireste iresti irete irò irono isca iscano isce isci isco iscono issero ita ite iti ito iva ivamo ivano ivate ivi ivo ono uta ute uti uto ar ir"
)


def italian(word: str) -> str:
    w = word.translate(str.maketrans("áéíóú", "àèìòù")).replace("qu", "qU")
    w = _between(w, "ui", _IT_V)
    r1, r2 = _regions(w, _IT_V)
    rv = _rv(w, _IT_V)
    end, _ = _ending(w, _IT_0, rv)
    stem = w[: len(w) - len(end)]
    if end:
        if stem.endswith(("ando", "endo")) and len(stem) - 4 >= rv:
            w = stem
        elif stem.endswith(("ar", "er", "ir")) and len(stem) - 2 >= rv:
            w = stem + "e"
    first = w
    end, group = _ending(w, _IT_1)
    stem = w[: len(w) - len(end)]
    if end and len(stem) >= (rv if group == 5 else r1 if group == 6 else r2):
        if group in (0, 5):
            w = stem
        elif group == 1:
            w = _cut(stem, "ic", r2)
        elif group < 5:
            w = stem + ("log", "u", "ente")[group - 2]
        elif group == 6:
            w = _adverb(stem, r2, ("os", "ic", "abil"))
        elif group == 7:
            w = _first_cut(stem, ("abil", "ic", "iv"), r2)
        else:
            cut = _cut(stem, "at", r2)
            w = _cut(cut, "ic", r2) if cut != stem else cut
    if w == first:
        end, _ = _ending(w, _IT_2, rv)
        w = w[: len(w) - len(end)]
    if w[-1:] and w[-1] in "aeioàèìò" and len(w) - 1 >= rv:
        w = w[:-1]
        w = _cut(w, "i", rv)
    if w.endswith(("ch", "gh")) and len(w) - 2 >= rv:
        w = w[:-1]
    return w.lower()


_PT_V = "aeiouáéíóúâêô"
_PT_1 = _by_length(
    "eza ezas ico ica icos icas ismo ismos ável ível ista istas oso osa osos osas amento amentos imento imentos adora ador aça~o adoras adores aço~es ante antes ância",
    "logia logias", "uça~o uço~es", "ência ências", "amente", "mente", "idade idades", "iva ivo ivas ivos", "ira iras",
)
_PT_2 = _by_length(
    "ada ida ia aria eria iria ará ara erá era irá ava asse esse isse aste este iste ei arei erei irei am iam ariam eriam iriam aram eram iram avam em arem erem irem assem essem issem ado ido ando endo indo ara~o era~o ira~o ar er ir as adas idas ias arias erias irias arás aras erás eras irás avas es ardes erdes irdes ares eres ires asses esses isses astes estes istes is ais eis íeis aríeis eríeis iríeis áreis areis éreis ereis íreis ireis ásseis ésseis ísseis áveis ados idos ámos amos íamos aríamos eríamos iríamos áramos éramos íramos ávamos emos aremos eremos iremos ássemos êssemos íssemos imos armos ermos irmos eu iu ou ira iras"
)
_PT_4 = _by_length("os a i o á í ó")


def portuguese(word: str) -> str:
    w = word.replace("ã", "a~").replace("õ", "o~")
    r1, r2 = _regions(w, _PT_V)
    rv = _rv(w, _PT_V)
    first = w
    end, group = _ending(w, _PT_1)
    stem = w[: len(w) - len(end)]
    if end and len(stem) >= (r1 if group == 4 else rv if group == 8 else r2):
        if group == 0:
            w = stem
        elif group < 4:
            w = stem + ("log", "u", "ente")[group - 1]
        elif group == 4:
            w = _adverb(stem, r2, ("os", "ic", "ad"))
        elif group < 8:
            w = _first_cut(stem, (("ante", "avel", "ível"), ("abil", "ic", "iv"), ("at",))[group - 5], r2)
        elif stem.endswith("e"):
            w = stem + "ir"
    if w == first:
        end, _ = _ending(w, _PT_2, rv)
        w = w[: len(w) - len(end)]
    if w != first:
        if w.endswith("ci") and len(w) - 1 >= rv:
            w = w[:-1]
    else:
        end, _ = _ending(w, _PT_4, rv)
        w = w[: len(w) - len(end)]
    if w[-1:] and w[-1] in "eéê" and len(w) - 1 >= rv:
        w = w[:-1]
        if w.endswith(("gu", "ci")) and len(w) - 1 >= rv:
            w = w[:-1]
    elif w.endswith("ç"):
        w = w[:-1] + "c"
    return w.replace("a~", "ã").replace("o~", "õ")


# Russian

_RU_V = "аеиоуыэюя"
_RU_GERUND = _by_length("в вши вшись", "ив ивши ившись ыв ывши ывшись")
_RU_ADJECTIVE = _by_length("ее ие ые ое ими ыми ей ий ый ой ем им ым ом его ого ему ому их ых ую юю ая яя ою ею")
_RU_PARTICIPLE = _by_length("ем нн вш ющ щ", "ивш ывш ующ")
_RU_VERB = _by_length("ла на ете йте ли й л ем н ло но ет ют ны ть ешь нно", "ила ыла ена ейте уйте ите или ыли ей уй ил ыл им ым ен ило ыло ено ят ует уют ит ыт ены ить ыть ишь ую ю")
_RU_NOUN = _by_length("а ев ов ие ье е иями ями ами еи ии и ией ей ой ий й иям ям ием ем ам ом о у ах иях ях ы ь ию ью ю ия ья я")


def russian(word: str) -> str:
    w = word.replace("ё", "е")
    rv = next((i + 1 for i, c in enumerate(w) if c in _RU_V), len(w))
    _, r2 = _regions(w, _RU_V)

    def drop(suffixes: list[tuple[str, int]], w: str) -> str:
        """w without its longest suffix within RV; one of group 0 of two groups must follow а or я."""
        groups = len({g for _, g in suffixes})
        for s, g in suffixes:
            at = len(w) - len(s)
            if at >= rv and w.endswith(s) and (groups == 1 or g == 1 or (at - 1 >= rv and w[at - 1] in "ая")):
                return w[:at]
        return w

    new = drop(_RU_GERUND, w)
    if new == w:
        w = drop(_by_length("ся сь"), w)
        new = drop(_RU_ADJECTIVE, w)
        if new != w:
            new = drop(_RU_PARTICIPLE, new)
        else:
            new = drop(_RU_VERB, w)
            if new == w:
                new = drop(_RU_NOUN, w)
    w = _cut(new, "и", rv)
    w = _cut(w, "ость" if w.endswith("ость") else "ост", max(r2, rv))
    if w.endswith("нн") and len(w) - 2 >= rv:
        return w[:-1]
    new = drop(_by_length("ейш ейше"), w)
    if new != w:
        return new[:-1] if new.endswith("нн") and len(new) - 2 >= rv else new
    return _cut(w, "ь", rv)


STEMMERS: dict[str, Callable[[str], str]] = {"english": english, "german": german, "french": french, "spanish": spanish, "italian": italian, "portuguese": portuguese, "russian": russian}
