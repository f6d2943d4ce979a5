"""The primary key of Double Metaphone, the published sound key for names of many origins."""

from __future__ import annotations

VOWELS = set("AEIOUY")


class _Word:
    """A word with looks past its ends."""

    def __init__(self, text: str):
        self.text, self.last = text, len(text) - 1
        self.slavic = any(g in text for g in ("W", "K", "CZ", "WITZ"))
        self.germanic = text.startswith(("VAN ", "VON ", "SCH"))

    def at(self, i: int, n: int = 1) -> str:
        return self.text[i : i + n].ljust(n) if i >= 0 else ""

    def vowel(self, i: int) -> bool:
        return 0 <= i <= self.last and self.text[i] in VOWELS


def _c(w: _Word, i: int) -> tuple[str, int]:
    at = w.at
    if i > 1 and not w.vowel(i - 2) and at(i - 1, 3) == "ACH" and at(i + 2) != "I" and (at(i + 2) != "E" or at(i - 2, 6) in ("BACHER", "MACHER")):
        return "K", 2
    if i == 0 and at(0, 6) == "CAESAR":
        return "S", 2
    if at(i, 4) == "CHIA":
        return "K", 2
    if at(i, 2) == "CH":
        greek = i == 0 and (at(1, 5) in ("HARAC", "HARIS") or at(1, 3) in ("HOR", "HYM", "HIA", "HEM")) and at(0, 5) != "CHORE"
        hard = w.germanic or at(i - 2, 6) in ("ORCHES", "ARCHIT", "ORCHID") or at(i + 2) in ("T", "S") or ((i == 0 or at(i - 1) in ("A", "O", "U", "E")) and at(i + 2) in tuple("LRNMBHFVW "))
        return "K" if i > 0 and at(i, 4) == "CHAE" or greek or hard or i > 0 and at(0, 2) == "MC" else "X", 2
    if at(i, 2) == "CZ" and at(i - 2, 4) != "WICZ":
        return "S", 2
    if at(i + 1, 3) == "CIA":
        return "X", 3
    if at(i, 2) == "CC" and not (i == 1 and at(0) == "M"):
        if at(i + 2) in ("I", "E", "H") and at(i + 2, 2) != "HU":
            return "KS" if i == 1 and at(0) == "A" or at(i - 1, 5) in ("UCCEE", "UCCES") else "X", 3
        return "K", 2
    if at(i, 2) in ("CK", "CG", "CQ"):
        return "K", 2
    if at(i, 2) in ("CI", "CE", "CY"):
        return "S", 2
    if at(i + 1, 2) in (" C", " Q", " G"):
        return "K", 3
    return "K", 2 if at(i + 1) in ("C", "K", "Q") and at(i + 1, 2) not in ("CE", "CI") else 1


def _g(w: _Word, i: int) -> tuple[str, int]:
    at = w.at
    if at(i + 1) == "H":
        if i > 0 and not w.vowel(i - 1):
            return "K", 2
        if i == 0:
            return "J" if at(2) == "I" else "K", 2
        if i > 1 and at(i - 2) in ("B", "H", "D") or i > 2 and at(i - 3) in ("B", "H", "D") or i > 3 and at(i - 4) in ("B", "H"):
            return "", 2
        if i > 2 and at(i - 1) == "U" and at(i - 3) in ("C", "G", "L", "R", "T"):
            return "F", 2
        return "K" if at(i - 1) != "I" else "", 2
    if at(i + 1) == "N":
        silent = not w.slavic and not (i == 1 and w.vowel(0)) and at(i + 2, 2) != "EY"
        return "N" if silent else "KN", 2
    if at(i + 1, 2) == "LI" and not w.slavic:
        return "KL", 2
    if i == 0 and (at(1) == "Y" or at(1, 2) in ("ES", "EP", "EB", "EL", "EY", "IB", "IL", "IN", "IE", "EI", "ER")):
        return "K", 2
    if (at(i + 1, 2) == "ER" or at(i + 1) == "Y") and at(0, 6) not in ("DANGER", "RANGER", "MANGER") and at(i - 1) not in ("E", "I") and at(i - 1, 3) not in ("RGY", "OGY"):
        return "K", 2
    if at(i + 1) in ("E", "I", "Y") or at(i - 1, 4) in ("AGGI", "OGGI"):
        return "K" if w.germanic or at(i + 1, 2) == "ET" else "J", 2
    return "K", 2 if at(i + 1) == "G" else 1


def _j(w: _Word, i: int) -> tuple[str, int]:
    at, step = w.at, 2 if w.at(i + 1) == "J" else 1
    if at(i, 4) == "JOSE" or at(0, 4) == "SAN ":
        return "H" if i == 0 and at(4) == " " or at(0, 4) == "SAN " else "J", 1
    spoken = i == 0 or i == w.last or w.vowel(i - 1) and not w.slavic and at(i + 1) in ("A", "O") or at(i + 1) not in tuple("LTKSNMBZ") and at(i - 1) not in ("S", "K", "L")
    return "J" if spoken else "", step


def _s(w: _Word, i: int) -> tuple[str, int]:
    at = w.at
    if at(i - 1, 3) in ("ISL", "YSL"):
        return "", 1
    if i == 0 and at(0, 5) == "SUGAR":
        return "X", 1
    if at(i, 2) == "SH":
        return "S" if at(i + 1, 4) in ("HEIM", "HOEK", "HOLM", "HOLZ") else "X", 2
    if at(i, 3) in ("SIO", "SIA"):
        return "S", 3
    if i == 0 and at(1) in ("M", "N", "L", "W") or at(i + 1) == "Z":
        return "S", 2 if at(i + 1) == "Z" else 1
    if at(i, 2) == "SC":
        if at(i + 2) == "H":
            return "SK" if at(i + 3, 2) in ("OO", "UY", "ED", "EM") else "X", 3
        return "S" if at(i + 2) in ("I", "E", "Y") else "SK", 3
    return "" if i == w.last and at(i - 2, 2) in ("AI", "OI") else "S", 2 if at(i + 1) in ("S", "Z") else 1


def _w(w: _Word, i: int) -> tuple[str, int]:
    at = w.at
    if at(i, 2) == "WR":
        return "R", 2
    if i == 0 and (w.vowel(1) or at(0, 2) == "WH"):
        return "A", 1
    return ("TS", 4) if at(i, 4) in ("WICZ", "WITZ") else ("", 1)


def _t(w: _Word, i: int) -> tuple[str, int]:
    at = w.at
    if at(i, 4) == "TION" or at(i, 3) in ("TIA", "TCH"):
        return "X", 3
    if at(i, 2) == "TH" or at(i, 3) == "TTH":
        return "T" if at(i + 2, 2) in ("OM", "AM") or w.germanic else "0", 2
    return "T", 2 if at(i + 1) in ("T", "D") else 1


def _d(w: _Word, i: int) -> tuple[str, int]:
    if w.at(i, 2) == "DG":
        return ("J", 3) if w.at(i + 2) in ("I", "E", "Y") else ("TK", 2)
    return "T", 2 if w.at(i, 2) in ("DT", "DD") else 1


def _other(w: _Word, i: int) -> tuple[str, int]:
    at, c = w.at, w.at(i)
    if c in VOWELS:
        return "A" if i == 0 else "", 1
    if c == "H":
        return ("H", 2) if (i == 0 or w.vowel(i - 1)) and w.vowel(i + 1) else ("", 1)
    if c == "M":
        return "M", 2 if at(i - 1, 3) == "UMB" and (i + 1 == w.last or at(i + 2, 2) == "ER") or at(i + 1) == "M" else 1
    if c == "P":
        return ("F", 2) if at(i + 1) == "H" else ("P", 2 if at(i + 1) in ("P", "B") else 1)
    if c == "R":
        silent = i == w.last and not w.slavic and at(i - 2, 2) == "IE" and at(i - 4, 2) not in ("ME", "MA")
        return "" if silent else "R", 2 if at(i + 1) == "R" else 1
    if c == "X":
        silent = i == w.last and (at(i - 3, 3) in ("IAU", "EAU") or at(i - 2, 2) in ("AU", "OU"))
        return "" if silent else "KS", 2 if at(i + 1) in ("C", "X") else 1
    if c == "Z":
        return ("J", 2) if at(i + 1) == "H" else ("S", 2 if at(i + 1) == "Z" else 1)
    sound = {"B": "P", "Ç": "S", "F": "F", "K": "K", "L": "L", "N": "N", "Ñ": "N", "Q": "K", "V": "F"}.get(c, "")
    return sound, 2 if sound and c not in "ÇÑ" and at(i + 1) == c else 1


_RULES = {"C": _c, "D": _d, "G": _g, "J": _j, "S": _s, "T": _t, "W": _w}


def double_metaphone(name: str, n: int = 4) -> str:
    """The primary key, of at most ``n`` letters; empty for a text without letters that sound."""
    w = _Word(name.upper().strip())
    i, out = 0, ""
    if w.at(0, 2) in ("GN", "KN", "PN", "WR", "PS"):
        i = 1
    elif w.at(0) == "X":
        i, out = 1, "S"
    while i <= w.last and len(out) < n:
        sound, step = _RULES.get(w.text[i], _other)(w, i)
        out += sound
        i += step
    return out[:n]
