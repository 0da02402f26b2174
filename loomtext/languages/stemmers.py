"""Stemmers by the published suffix-stripping algorithms: Porter and Porter2 for English, and the Snowball family for others.

Words are lower-cased first. A region R1 is what follows the first non-vowel after a vowel, R2 the same within R1; suffixes are
only taken where they lie in the region that a step names.
"""

from __future__ import annotations

import re
from collections.abc import Callable


def _region(word: str, vowels: str, start: int = 0) -> int:
    """Where the part after the first non-vowel that follows a vowel begins."""
    for i in range(start + 1, len(word)):
        if word[i] not in vowels and word[i - 1] in vowels:
            return i + 1
    return len(word)


def _longest(word: str, suffixes, at: int = 0) -> str | None:
    """The longest of the suffixes that the part of the word from ``at`` on ends with."""
    part = word[at:]
    found = [s for s in suffixes if part.endswith(s)]
    return max(found, key=len) if found else None


# --- English -----------------------------------------------------------------------------------------------------------------

_EN_VOWELS = "aeiouy"
# The irregular words of the English algorithm.
_EN_SPECIAL = {"skis": "ski", "skies": "sky", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes"}
_EN_LATE = {"inning", "outing", "canning", "herring", "earring", "evening", "proceed", "exceed", "succeed"}
_EN_FRONTS = ("gener", "commun", "arsen", "past", "univers", "later", "emerg", "organ", "inter")
_EN_STEP2 = {"tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "fulli": "ful", "lessli": "less", "ogist": "og", "ogi": "og", "li": ""}
_EN_STEP3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
_EN_STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion")
_EN_DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")


def _en_short_end(w: str) -> bool:
    return bool(re.search(r"[^aeiouy][aeiouy][^aeiouywxY]$|^[aeiouy][^aeiouy]$", w))


def porter2(word: str) -> str:
    w = word.lower()
    if len(w) < 3:
        return w
    w = w.removeprefix("'")
    if w in _EN_SPECIAL:
        return _EN_SPECIAL[w]
    w = re.sub(r"^y|(?<=[aeiouy])y", "Y", w)
    front = next((p for p in _EN_FRONTS if w.startswith(p)), None)
    r1 = len(front) if front else _region(w, _EN_VOWELS)
    r2 = _region(w, _EN_VOWELS, r1)
    w = re.sub(r"('s'|'s|')$", "", w)
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and re.search("[aeiouy]", w[:-2]):
        w = w[:-1]
    if w in _EN_LATE:
        return w
    if s := _longest(w, ("eed", "eedly")):
        if len(w) - len(s) >= r1:
            w = w[: -len(s)] + "ee"
    elif re.fullmatch("[^aeiouy]ying", w.lower()):
        w = w[:-4] + "ie"
    elif (s := _longest(w, ("ed", "edly", "ing", "ingly"))) and re.search("[aeiouy]", w[: -len(s)]):
        w = w[: -len(s)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif w.endswith(_EN_DOUBLES):
            w = w[:-1]
        elif r1 >= len(w) and _en_short_end(w):
            w += "e"
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in _EN_VOWELS:
        w = w[:-1] + "i"
    if (s := _longest(w, _EN_STEP2)) and len(w) - len(s) >= r1:
        stem = w[: -len(s)]
        if (s != "li" or stem[-1:] in "cdeghkmnrt") and (s != "ogi" or stem.endswith("l")):
            w = stem + _EN_STEP2[s]
    if (s := _longest(w, _EN_STEP3)) and len(w) - len(s) >= r1 and (s != "ative" or len(w) - len(s) >= r2):
        w = w[: -len(s)] + _EN_STEP3[s]
    if (s := _longest(w, _EN_STEP4)) and len(w) - len(s) >= r2 and (s != "ion" or w[: -len(s)].endswith(("s", "t"))):
        w = w[: -len(s)]
    if w.endswith("e") and (len(w) > r2 or (len(w) > r1 and not _en_short_end(w[:-1]))):
        w = w[:-1]
    elif w.endswith("ll") and len(w) > r2:
        w = w[:-1]
    return w.lower()


def _measure(stem: str) -> int:
    kinds = re.sub("c+", "c", re.sub("v+", "v", "".join("v" if ch in "aeiou" or (ch == "y" and i and stem[i - 1] not in "aeiou") else "c" for i, ch in enumerate(stem))))
    return kinds.count("vc")


def _has_vowel(stem: str) -> bool:
    return any(ch in "aeiou" or (ch == "y" and i and stem[i - 1] not in "aeiou") for i, ch in enumerate(stem))


def _cvc(w: str) -> bool:
    return bool(re.search(r"[^aeiou][aeiouy][^aeiouwxy]$", w))


_P_STEP2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble"}
_P_STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}


def porter(word: str) -> str:
    w = word.lower()
    if len(w) < 3:
        return w
    if w.endswith(("sses", "ies")):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    elif (s := _longest(w, ("ed", "ing"))) and _has_vowel(w[: -len(s)]):
        w = w[: -len(s)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif len(w) > 1 and w[-1] == w[-2] and w[-1] not in "aeioulsz":
            w = w[:-1]
        elif _measure(w) == 1 and _cvc(w):
            w += "e"
    if w.endswith("y") and _has_vowel(w[:-1]):
        w = w[:-1] + "i"
    for table, least in ((_P_STEP2, 0), (_P_STEP3, 0)):
        if (s := _longest(w, table)) and _measure(w[: -len(s)]) > least:
            w = w[: -len(s)] + table[s]
    if (s := _longest(w, (*_EN_STEP4, "ou"))) and _measure(w[: -len(s)]) > 1 and (s != "ion" or w[: -len(s)].endswith(("s", "t"))):
        w = w[: -len(s)]
    if w.endswith("e") and (_measure(w[:-1]) > 1 or (_measure(w[:-1]) == 1 and not _cvc(w[:-1]))):
        w = w[:-1]
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w


# --- Germanic ----------------------------------------------------------------------------------------------------------------


def german(word: str) -> str:
    vowels = "aeiouyäöü"
    w = word.lower().replace("ß", "ss")
    w = re.sub(r"(?<=[aeiouyäöü])([uy])(?=[aeiouyäöü])", lambda m: m[1].upper(), w)
    r1 = max(3, _region(w, vowels))
    r2 = _region(w, vowels, _region(w, vowels))
    if s := _longest(w, ("em", "ern", "er", "e", "en", "es", "s"), r1):
        if s != "s" or w[:-1].endswith(tuple("bdfghklmnrt")):
            w = w[: -len(s)]
            if s in ("e", "en", "es") and w.endswith("niss"):
                w = w[:-1]
    if (s := _longest(w, ("en", "er", "est", "st"), r1)) and (s != "st" or (len(w) > 5 and w[:-2].endswith(tuple("bdfghklmnt")))):
        w = w[: -len(s)]
    if s := _longest(w, ("end", "ung", "ig", "ik", "isch", "lich", "heit", "keit"), r2):
        stem = w[: -len(s)]
        if s in ("end", "ung"):
            w = stem
            if w.endswith("ig") and len(w) - 2 >= r2 and not w.endswith("eig"):
                w = w[:-2]
        elif s in ("ig", "ik", "isch"):
            w = w if stem.endswith("e") else stem
        elif s in ("lich", "heit"):
            w = stem
            if w.endswith(("er", "en")) and len(w) - 2 >= r1:
                w = w[:-2]
        else:
            w = stem
            if (t := _longest(w, ("lich", "ig"))) and len(w) - len(t) >= r2:
                w = w[: -len(t)]
    return w.lower().replace("ä", "a").replace("ö", "o").replace("ü", "u")


_SV_1 = "a arna erna heterna orna ad e ade ande arne are aste en anden aren heten ern ar er heter or as arnas ernas ornas es ades andes ens arens hetens erns at andet het ast".split()


def swedish(word: str) -> str:
    w = word.lower()
    r1 = max(3, _region(w, "aeiouyäåö"))
    s = _longest(w, (*_SV_1, "s"), r1)
    if s == "s":
        w = w[:-1] if w[:-1].endswith(tuple("bcdfghjklmnoprtvy")) else w
    elif s:
        w = w[: -len(s)]
    if _longest(w, ("dd", "gd", "nn", "dt", "gt", "kt", "tt"), r1):
        w = w[:-1]
    if s := _longest(w, ("lig", "ig", "els", "löst", "fullt"), r1):
        w = w[: -len(s)] if s in ("lig", "ig", "els") else w[:-1]
    return w


_NO_1 = "a e ede ande ende ane ene hetene en heten ar er heter as es edes endes enes hetenes ens hetens ers ets et het ast".split()


def norwegian(word: str) -> str:
    w = word.lower()
    r1 = max(3, _region(w, "aeiouyæåø"))
    s = _longest(w, (*_NO_1, "s", "erte", "ert"), r1)
    if s == "s":
        w = w[:-1] if w[:-1].endswith(tuple("bcdfghjlmnoprtvyz")) or re.search(r"[^aeiouyæåø]k$", w[:-1]) else w
    elif s in ("erte", "ert"):
        w = w[: -len(s)] + "er"
    elif s:
        w = w[: -len(s)]
    if _longest(w, ("dt", "vt"), r1):
        w = w[:-1]
    if s := _longest(w, ("leg", "eleg", "ig", "eig", "lig", "elig", "els", "lov", "elov", "slov", "hetslov"), r1):
        w = w[: -len(s)]
    return w


_DA_1 = "hed ethed ered e erede ende erende ene erne ere en heden eren er heder erer heds es endes erendes enes ernes eres ens hedens erens ers ets erets et eret".split()


def danish(word: str) -> str:
    w = word.lower()
    r1 = max(3, _region(w, "aeiouyæåø"))
    s = _longest(w, (*_DA_1, "s"), r1)
    if s == "s":
        w = w[:-1] if w[:-1].endswith(tuple("abcdfghjklmnoprtvyzå")) else w
    elif s:
        w = w[: -len(s)]
    pair = lambda x: x[:-1] if _longest(x, ("gd", "dt", "gt", "kt"), r1) else x
    w = pair(w)
    if w.endswith("igst"):
        w = w[:-2]
    if s := _longest(w, ("ig", "lig", "elig", "els", "løst"), r1):
        w = w[:-1] if s == "løst" else pair(w[: -len(s)])
    if len(w) - 2 >= r1 - 1 and len(w) > r1 and re.search(r"([^aeiouyæåø])\1$", w):
        w = w[:-1]
    return w


def dutch(word: str) -> str:
    vowels = "aeiouyè"
    w = word.lower().translate(str.maketrans("äëïöüáéíóú", "aeiouaeiou"))
    w = re.sub(r"^y|(?<=[aeiouyè])y", "Y", w)
    w = re.sub(r"(?<=[aeiouyè])i(?=[aeiouyè])", "I", w)
    r1 = max(3, _region(w, vowels))
    r2 = _region(w, vowels, _region(w, vowels))
    undouble = lambda x: x[:-1] if x.endswith(("kk", "dd", "tt")) else x

    def en_ending(x: str, s: str) -> str:
        stem = x[: -len(s)]
        return undouble(stem) if len(stem) >= r1 and stem and stem[-1] not in vowels and not stem.endswith("gem") else x

    s = _longest(w, ("heden", "en", "ene", "s", "se"))
    if s == "heden":
        w = w[:-5] + "heid" if len(w) - 5 >= r1 else w
    elif s in ("en", "ene"):
        w = en_ending(w, s)
    elif s and len(w) - len(s) >= r1 and re.search(r"[^aeiouyèj]$", w[: -len(s)]):
        w = w[: -len(s)]
    removed = False
    if w.endswith("e") and len(w) - 1 >= r1 and len(w) > 1 and w[-2] not in vowels:
        w, removed = undouble(w[:-1]), True
    if w.endswith("heid") and len(w) - 4 >= r2 and not w.endswith("cheid"):
        w = w[:-4]
        if w.endswith("en"):
            w = en_ending(w, "en")
    if s := _longest(w, ("end", "ing", "ig", "lijk", "baar", "bar")):
        stem = w[: -len(s)]
        if len(stem) >= r2:
            if s in ("end", "ing"):
                w = stem[:-2] if stem.endswith("ig") and len(stem) - 2 >= r2 and not stem.endswith("eig") else undouble(stem)
            elif s == "ig":
                w = w if stem.endswith("e") else stem
            elif s == "lijk":
                w = stem
                if w.endswith("e") and len(w) - 1 >= r1 and len(w) > 1 and w[-2] not in vowels:
                    w = undouble(w[:-1])
            elif s == "baar" or removed:
                w = stem
    if re.search(r"[^aeiouyèI](aa|ee|oo|uu)[^aeiouyèI]$", w):
        w = w[:-2] + w[-1]
    return w.lower()


# --- Romance -----------------------------------------------------------------------------------------------------------------


def _rv(word: str, vowels: str) -> int:
    """The region of the Romance algorithms: after the next vowel or consonant, by how the word begins."""
    if len(word) > 2:
        if word[1] not in vowels:
            return next((i + 1 for i in range(2, len(word)) if word[i] in vowels), len(word))
        if word[0] in vowels:
            return next((i + 1 for i in range(2, len(word)) if word[i] not in vowels), len(word))
        return 3
    return len(word)


def _regions(word: str, vowels: str) -> tuple[int, int, int]:
    r1 = _region(word, vowels)
    return _rv(word, vowels), r1, _region(word, vowels, r1)


_ES_PRONOUNS = "me se sela selo selas selos la le lo las les los nos".split()
_ES_GERUNDS = {"iéndo": "iendo", "ándo": "ando", "ár": "ar", "ér": "er", "ír": "ir"}
_ES_2B = """arían arías arán arás aríais aría aréis aríamos aremos ará aré erían erías erán erás eríais ería eréis eríamos eremos erá eré irían irías irán irás iríais iría iréis
iríamos iremos irá iré aba ada ida ía ara iera ad ed id ase iese aste iste an aban ían aran ieran asen iesen aron ieron ado ido ando iendo ió ar er ir as abas adas idas ías aras ieras ases ieses ís áis
abais íais arais ierais aseis ieseis asteis isteis ados idos amos ábamos íamos imos áramos iéramos iésemos ásemos""".split()


def spanish(word: str) -> str:
    vowels = "aeiouáéíóúü"
    w = word.lower()
    rv, r1, r2 = _regions(w, vowels)
    if s := _longest(w, _ES_PRONOUNS):
        stem = w[: -len(s)]
        if (t := _longest(stem, _ES_GERUNDS)) and len(stem) - len(t) >= rv:
            w = stem[: -len(t)] + _ES_GERUNDS[t]
        elif (t := _longest(stem, ("ando", "iendo", "ar", "er", "ir", "yendo"))) and len(stem) - len(t) >= rv and (t != "yendo" or stem[:-5].endswith("u")):
            w = stem
    before = w
    endings = {
        "": "anza anzas ico ica icos icas ismo ismos able ables ible ibles ista istas oso osa osos osas amiento amientos imiento imientos".split(),
        "ic": "adora ador ación adoras adores aciones ante antes ancia ancias acion".split(),
        "log": "logía logías".split(), "u": "ución uciones".split(), "ente": "encia encias".split(),
        "amente": ["amente"], "mente": ["mente"], "idad": "idad idades".split(), "iv": "iva ivo ivas ivos".split(),
    }
    s = _longest(w, [x for xs in endings.values() for x in xs])
    kind = next((k for k, xs in endings.items() if s in xs), None) if s else None
    if s and len(w) - len(s) >= (r1 if kind == "amente" else r2):
        w = w[: -len(s)]
        cut = lambda x, *ends: x[: -len(t)] if (t := _longest(x, ends)) and len(x) - len(t) >= r2 else x
        if kind == "ic":
            w = cut(w, "ic")
        elif kind in ("log", "u", "ente"):
            w += kind
        elif kind == "amente":
            if w.endswith("iv") and len(w) - 2 >= r2:
                w = cut(w[:-2], "at")
            else:
                w = cut(w, "os", "ic", "ad")
        elif kind == "mente":
            w = cut(w, "ante", "able", "ible")
        elif kind == "idad":
            w = cut(w, "abil", "ic", "iv")
        elif kind == "iv":
            w = cut(w, "at")
    if w == before:
        y = _longest(w, "ya ye yan yen yeron yendo yo yó yas yes yais yamos".split(), rv)
        if y and w[: -len(y)].endswith("u"):
            w = w[: -len(y)]
        elif s := _longest(w, [*_ES_2B, "en", "es", "éis", "emos"], rv):
            w = w[: -len(s)]
            if s in ("en", "es", "éis", "emos") and w.endswith("gu"):
                w = w[:-1]
    if s := _longest(w, ("os", "a", "o", "á", "í", "ó", "e", "é"), rv):
        w = w[: -len(s)]
        if s in ("e", "é") and w.endswith("gu") and len(w) - 1 >= rv:
            w = w[:-1]
    return w.translate(str.maketrans("áéíóú", "aeiou"))


_PT_1 = "eza ezas ico ica icos icas ismo ismos ável ível ista istas oso osa osos osas amento amentos imento imentos adora ador aço~es adoras adores aça~o ante antes ância".split()
_PT_2 = """ada ida ia aria eria iria ará ara erá era irá ava asse esse isse aste este iste ei arei erei irei am iam ariam eriam iriam aram eram iram avam em arem erem irem assem essem issem ado ido ando endo indo
ara~o era~o ira~o ar er ir as adas idas ias arias erias irias arás aras erás eras irás avas es ardes erdes irdes ares eres ires asses esses isses astes estes istes is ais eis íeis aríeis eríeis iríeis áreis areis
éreis ereis íreis ireis ásseis ésseis ísseis áveis ados idos ámos amos íamos aríamos eríamos iríamos áramos éramos íramos ávamos emos aremos eremos iremos ássemos êssemos íssemos imos armos ermos irmos eu iu ou ira iras""".split()


def portuguese(word: str) -> str:
    vowels = "aeiouáéíóúâêô"
    w = word.lower().replace("ã", "a~").replace("õ", "o~")
    rv, r1, r2 = _regions(w, vowels)
    before = w
    cut = lambda x, *ends: x[: -len(t)] if (t := _longest(x, ends)) and len(x) - len(t) >= r2 else x
    other = {"logia": "log", "logias": "log", "ução": "u", "uça~o": "u", "uço~es": "u", "ência": "ente", "ências": "ente"}
    more = ("amente", "mente", "idade", "idades", "iva", "ivo", "ivas", "ivos", "ira", "iras")
    s = _longest(w, [*_PT_1, *other, *more])
    if s in other and len(w) - len(s) >= r2:
        w = w[: -len(s)] + other[s]
    elif s in _PT_1 and len(w) - len(s) >= r2:
        w = w[: -len(s)]
    elif s == "amente" and len(w) - 6 >= r1:
        w = w[:-6]
        w = cut(w[:-2], "at") if w.endswith("iv") and len(w) - 2 >= r2 else cut(w, "os", "ic", "ad")
    elif s == "mente" and len(w) - 5 >= r2:
        w = cut(w[:-5], "ante", "avel", "ível")
    elif s in ("idade", "idades") and len(w) - len(s) >= r2:
        w = cut(w[: -len(s)], "abil", "ic", "iv")
    elif s in ("iva", "ivo", "ivas", "ivos") and len(w) - len(s) >= r2:
        w = cut(w[: -len(s)], "at")
    elif s in ("ira", "iras") and len(w) - len(s) >= rv and w[: -len(s)].endswith("e"):
        w = w[: -len(s)] + "ir"
    if w == before and (s := _longest(w, _PT_2, rv)):
        w = w[: -len(s)]
    if w != before:
        if w.endswith("i") and len(w) - 1 >= rv and w[:-1].endswith("c"):
            w = w[:-1]
    elif s := _longest(w, ("os", "a", "i", "o", "á", "í", "ó"), rv):
        w = w[: -len(s)]
    if (s := _longest(w, ("e", "é", "ê"), rv)) is not None:
        w = w[: -len(s)]
        if w.endswith(("gu", "ci")) and len(w) - 1 >= rv:
            w = w[:-1]
    elif w.endswith("ç"):
        w = w[:-1] + "c"
    return w.replace("a~", "ã").replace("o~", "õ")


_IT_PRONOUNS = "ci gli la le li lo mi ne si ti vi sene gliela gliele glieli glielo gliene mela mele meli melo mene tela tele teli telo tene cela cele celi celo cene vela vele veli velo vene".split()
_IT_1 = "anza anze ico ici ica ice iche ichi ismo ismi abile abili ibile ibili ista iste isti istà istè istì oso osi osa ose mente atrice atrici ante anti".split()
_IT_2 = """ammo ando ano are arono asse assero assi assimo ata ate ati ato ava avamo avano avate avi avo emmo enda ende endi endo erà erai eranno ere erebbe erebbero erei eremmo eremo ereste eresti erete erò
erono essero ete eva evamo evano evate evi evo Yamo iamo immo irà irai iranno ire irebbe irebbero irei iremmo iremo ireste iresti irete irò irono isca iscano isce isci isco iscono issero ita ite iti ito iva ivamo ivano
ivate ivi ivo ono uta ute uti uto ar ir""".split()


def italian(word: str) -> str:
    vowels = "aeiouàèìòù"
    w = word.lower().translate(str.maketrans("áéíóú", "àèìòù"))
    w = re.sub(r"(?<=q)u", "U", w)
    w = re.sub(r"(?<=[aeiouàèìòù])([ui])(?=[aeiouàèìòù])", lambda m: m[1].upper(), w)
    rv, r1, r2 = _regions(w, vowels)
    if s := _longest(w, _IT_PRONOUNS):
        stem = w[: -len(s)]
        if (t := _longest(stem, ("ando", "endo"))) and len(stem) - len(t) >= rv:
            w = stem
        elif (t := _longest(stem, ("ar", "er", "ir"))) and len(stem) - len(t) >= rv:
            w = stem + "e"
    before = w
    cut = lambda x, *ends: x[: -len(t)] if (t := _longest(x, ends)) and len(x) - len(t) >= r2 else x
    azione = ("azione", "azioni", "atore", "atori")
    other = {"logia": "log", "logie": "log", "uzione": "u", "uzioni": "u", "usione": "u", "usioni": "u", "enza": "ente", "enze": "ente"}
    s = _longest(w, [*_IT_1, *azione, *other, "amento", "amenti", "imento", "imenti", "amente", "ità", "ivo", "ivi", "iva", "ive"])
    at = len(w) - len(s) if s else -1
    if s in ("amento", "amenti", "imento", "imenti") and at >= rv:
        w = w[:at]
    elif s == "amente" and at >= r1:
        w = w[:at]
        w = cut(w[:-2], "at") if w.endswith("iv") and len(w) - 2 >= r2 else cut(w, "abil", "os", "ic")
    elif s and at >= r2 and s != "amente":
        if s in other:
            w = w[:at] + other[s]
        else:
            w = w[:at]
            if s in azione:
                w = cut(w, "ic")
            elif s == "ità":
                w = cut(w, "abil", "ic", "iv")
            elif s in ("ivo", "ivi", "iva", "ive") and w.endswith("at") and len(w) - 2 >= r2:
                w = cut(w[:-2], "ic")
    if w == before and (s := _longest(w, _IT_2, rv)):
        w = w[: -len(s)]
    if (s := _longest(w, tuple("aeioàèìò"), rv)) is not None:
        w = w[:-1]
        if w.endswith("i") and len(w) - 1 >= rv:
            w = w[:-1]
    if w.endswith(("ch", "gh")) and len(w) - 2 >= rv:
        w = w[:-1]
    return w.lower()


_FR_VERB_I = "îmes ît îtes i ie ies ir ira irai iraIent irais irait iras irent irez iriez irions irons iront is issaIent issais issait issant issante issantes issants isse issent isses issez issiez issions issons it".split()
_FR_VERB_E = "é ée ées és èrent er era erai eraIent erais erait eras erez eriez erions erons eront ez iez".split()
_FR_VERB_A = "âmes ât âtes a ai aIent ais ait ant ante antes ants as asse assent asses assiez assions".split()


def french(word: str) -> str:
    vowels = "aeiouyâàëéêèïîôûù"
    w = word.lower()
    w = re.sub(r"(?<=q)u", "U", w)
    w = re.sub(rf"(?<=[{vowels}])([ui])(?=[{vowels}])", lambda m: m[1].upper(), w)
    w = re.sub(rf"(?<=[{vowels}])y|y(?=[{vowels}])", "Y", w)
    if w.startswith(("par", "col", "tap")) or (len(w) > 2 and w[0] in vowels and w[1] in vowels):
        rv = 3
    else:
        rv = next((i + 1 for i in range(1, len(w)) if w[i] in vowels), len(w))
    r1 = _region(w, vowels)
    r2 = _region(w, vowels, r1)
    before, verbs = w, False
    lists = {
        "plain": "ance iqUe isme able iste eux ances iqUes ismes ables istes".split(), "atrice": "atrice ateur ation atrices ateurs ations".split(), "log": "logie logies".split(),
        "u": "usion ution usions utions".split(), "ent": "ence ences".split(), "ement": "ement ements".split(), "ité": "ité ités".split(), "if": "if ive ifs ives".split(),
        "eaux": ["eaux"], "aux": ["aux"], "euse": "euse euses".split(), "issement": "issement issements".split(), "amment": ["amment"], "emment": ["emment"], "ment": "ment ments".split(),
    }
    s = _longest(w, [x for xs in lists.values() for x in xs])
    kind = next((k for k, xs in lists.items() if s in xs), None) if s else None
    at = len(w) - len(s) if s else -1
    ends = lambda x, e, r: x.endswith(e) and len(x) - len(e) >= r
    if kind == "plain" and at >= r2:
        w = w[:at]
    elif kind == "atrice" and at >= r2:
        w = w[:at]
        if w.endswith("ic"):
            w = w[:-2] if len(w) - 2 >= r2 else w[:-2] + "iqU"
    elif kind in ("log", "u", "ent") and at >= r2:
        w = w[:at] + kind
    elif kind == "ement" and at >= rv:
        w = w[:at]
        if ends(w, "iv", r2):
            w = w[:-2]
            w = w[:-2] if ends(w, "at", r2) else w
        elif w.endswith("eus"):
            w = w[:-3] if len(w) - 3 >= r2 else w[:-1] + "x" if len(w) - 3 >= r1 else w
        elif (t := _longest(w, ("abl", "iqU"))) and len(w) - 3 >= r2:
            w = w[: -len(t)]
        elif (t := _longest(w, ("ièr", "Ièr"))) and len(w) - 3 >= rv:
            w = w[:-3] + "i"
    elif kind == "ité" and at >= r2:
        w = w[:at]
        if w.endswith("abil"):
            w = w[:-4] if len(w) - 4 >= r2 else w[:-4] + "abl"
        elif w.endswith("ic"):
            w = w[:-2] if len(w) - 2 >= r2 else w[:-2] + "iqU"
        elif ends(w, "iv", r2):
            w = w[:-2]
    elif kind == "if" and at >= r2:
        w = w[:at]
        if ends(w, "at", r2):
            w = w[:-2]
            if w.endswith("ic"):
                w = w[:-2] if len(w) - 2 >= r2 else w[:-2] + "iqU"
    elif kind == "eaux":
        w = w[:-1]
    elif kind == "aux" and at >= r1:
        w = w[:-2] + "l"
    elif kind == "euse":
        w = w[:at] if at >= r2 else w[:at] + "eux" if at >= r1 else w
    elif kind == "issement" and at >= r1 and at and w[at - 1] not in vowels:
        w = w[:at]
    elif kind == "amment" and at >= rv:
        w, verbs = w[:at] + "ant", True
    elif kind == "emment" and at >= rv:
        w, verbs = w[:at] + "ent", True
    elif kind == "ment" and at - 1 >= rv and w[at - 1] in vowels:
        w, verbs = w[:at], True
    changed = w != before
    if not changed or verbs:
        s = _longest(w, _FR_VERB_I, rv)
        if s and len(w) - len(s) - 1 >= rv and w[len(w) - len(s) - 1] not in vowels:
            w, changed = w[: -len(s)], True
        elif s := _longest(w, [*_FR_VERB_E, *_FR_VERB_A, "ions"], rv):
            if s == "ions":
                if len(w) - 4 >= r2:
                    w, changed = w[:-4], True
            else:
                w, changed = w[: -len(s)], True
                if s in _FR_VERB_A and ends(w, "e", rv):
                    w = w[:-1]
    if changed:
        w = w[:-1] + "i" if w.endswith("Y") else w[:-1] + "c" if w.endswith("ç") else w
    else:
        if w.endswith("s") and len(w) > 1 and w[-2] not in "aiouès":
            w = w[:-1]
        if (s := _longest(w, ("ion", "ier", "ière", "Ier", "Ière", "e", "ë"), rv)) is not None:
            if s == "ion":
                if len(w) - 3 >= r2 and len(w) - 4 >= rv and w[-4] in "st":
                    w = w[:-3]
            elif s in ("e", "ë"):
                if s == "e" or (w[:-1].endswith("gu") and len(w) - 3 >= rv):
                    w = w[:-1]
            else:
                w = w[: -len(s)] + "i"
    if w.endswith(("enn", "onn", "ett", "ell", "eill")):
        w = w[:-1]
    if m := re.search(rf"[éè]([^{vowels}]+)$", w):
        w = w[: m.start()] + "e" + m[1]
    return w.lower()


# --- Russian -----------------------------------------------------------------------------------------------------------------

_RU_GERUND = (("в", "вши", "вшись"), ("ив", "ивши", "ившись", "ыв", "ывши", "ывшись"))
_RU_ADJECTIVE = "ее ие ые ое ими ыми ей ий ый ой ем им ым ом его ого ему ому их ых ую юю ая яя ою ею".split()
_RU_PARTICIPLE = (("ем", "нн", "вш", "ющ", "щ"), ("ивш", "ывш", "ующ"))
_RU_VERB = ("ла на ете йте ли й л ем н ло но ет ют ны ть ешь нно".split(), "ила ыла ена ейте уйте ите или ыли ей уй ил ыл им ым ен ило ыло ено ят ует уют ит ыт ены ить ыть ишь ую ю".split())
_RU_NOUN = "а ев ов ие ье е иями ями ами еи ии и ией ей ой ий й иям ям ием ем ам ом о у ах иях ях ы ь ию ью ю ия ья я".split()


def _ru_cut(w: str, groups, rv: int) -> str | None:
    """The word without the longest suffix; those of the first group need а or я before them, inside the region."""
    s = _longest(w, [*groups[0], *groups[1]], rv)
    if not s or (s in groups[0] and s not in groups[1] and not (len(w) - len(s) - 1 >= rv and w[len(w) - len(s) - 1] in "ая")):
        return None
    return w[: -len(s)]


def russian(word: str) -> str:
    vowels = "аеиоуыэюя"
    w = word.lower().replace("ё", "е")
    rv = next((i + 1 for i, ch in enumerate(w) if ch in vowels), len(w))
    r2 = _region(w, vowels, _region(w, vowels))
    done = _ru_cut(w, _RU_GERUND, rv)
    if done is None:
        w = w[: -len(s)] if (s := _longest(w, ("ся", "сь"), rv)) else w
        if s := _longest(w, _RU_ADJECTIVE, rv):
            w = w[: -len(s)]
            done = _ru_cut(w, _RU_PARTICIPLE, rv)
            done = w if done is None else done
        else:
            done = _ru_cut(w, _RU_VERB, rv)
            if done is None:
                done = w[: -len(s)] if (s := _longest(w, _RU_NOUN, rv)) else w
    w = done
    if w.endswith("и") and len(w) - 1 >= rv:
        w = w[:-1]
    if s := _longest(w, ("ост", "ость"), r2):
        w = w[: -len(s)]
    if s := _longest(w, ("ейш", "ейше"), rv):
        w = w[: -len(s)]
    if w.endswith("нн") and len(w) - 1 >= rv:
        w = w[:-1]
    elif w.endswith("ь") and len(w) - 1 >= rv:
        w = w[:-1]
    return w


STEMMERS: dict[str, Callable[[str], str]] = {"en": porter2, "de": german, "sv": swedish, "no": norwegian, "nn": norwegian, "da": danish, "nl": dutch, "es": spanish, "pt": portuguese, "it": italian, "fr": french, "ru": russian}
