"""Characters of glyph names, as font encodings list them."""

from __future__ import annotations

import re
import unicodedata

# Names of marks that aren't letters with an accent.
MARKS = {
    "space": " ", "exclam": "!", "quotedbl": '"', "numbersign": "#", "dollar": "$", "percent": "%", "ampersand": "&", "quotesingle": "'", "parenleft": "(", "parenright": ")",
    "asterisk": "*", "plus": "+", "comma": ",", "hyphen": "-", "period": ".", "slash": "/", "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6",
    "seven": "7", "eight": "8", "nine": "9", "colon": ":", "semicolon": ";", "less": "<", "equal": "=", "greater": ">", "question": "?", "at": "@", "bracketleft": "[", "backslash": "\\",
    "bracketright": "]", "asciicircum": "^", "underscore": "_", "grave": "`", "braceleft": "{", "bar": "|", "braceright": "}", "asciitilde": "~", "exclamdown": "¡", "cent": "¢", "sterling": "£",
    "currency": "¤", "yen": "¥", "brokenbar": "¦", "section": "§", "dieresis": "¨", "copyright": "©", "ordfeminine": "ª", "guillemotleft": "«", "logicalnot": "¬", "registered": "®",
    "macron": "¯", "degree": "°", "plusminus": "±", "acute": "´", "mu": "µ", "paragraph": "¶", "periodcentered": "·", "cedilla": "¸", "ordmasculine": "º", "guillemotright": "»",
    "onequarter": "¼", "onehalf": "½", "threequarters": "¾", "questiondown": "¿", "multiply": "×", "divide": "÷", "AE": "Æ", "ae": "æ", "Oslash": "Ø", "oslash": "ø", "OE": "Œ", "oe": "œ",
    "germandbls": "ß", "Eth": "Ð", "eth": "ð", "Thorn": "Þ", "thorn": "þ", "dotlessi": "ı", "Lslash": "Ł", "lslash": "ł", "quoteleft": "‘", "quoteright": "’", "quotesinglbase": "‚",
    "quotedblleft": "“", "quotedblright": "”", "quotedblbase": "„", "dagger": "†", "daggerdbl": "‡", "bullet": "•", "ellipsis": "…", "perthousand": "‰", "guilsinglleft": "‹",
    "guilsinglright": "›", "endash": "–", "emdash": "—", "fraction": "⁄", "Euro": "€", "trademark": "™", "minus": "−", "florin": "ƒ", "circumflex": "ˆ", "tilde": "˜", "caron": "ˇ",
    "fi": "fi", "fl": "fl", "ff": "ff", "ffi": "ffi", "ffl": "ffl", "nbspace": "\xa0", "sfthyphen": "-",
}
# Accents at the end of a letter's name.
ACCENTS = {
    "acute": "ACUTE", "grave": "GRAVE", "circumflex": "CIRCUMFLEX", "dieresis": "DIAERESIS", "tilde": "TILDE", "ring": "RING ABOVE", "cedilla": "CEDILLA", "caron": "CARON",
    "breve": "BREVE", "macron": "MACRON", "ogonek": "OGONEK", "dotaccent": "DOT ABOVE", "hungarumlaut": "DOUBLE ACUTE", "commaaccent": "CEDILLA",
}
UNKNOWN = "�"


def character(name: str) -> str:
    """The text of a glyph name; a replacement character, never a wrong letter, for names that say nothing."""
    base = name.split(".")[0]
    if base in MARKS:
        return MARKS[base]
    if len(base) == 1:
        return base
    if m := re.fullmatch(r"uni((?:[0-9A-F]{4})+)|u([0-9A-F]{4,6})", base):
        codes = [int(m[1][k : k + 4], 16) for k in range(0, len(m[1]), 4)] if m[1] else [int(m[2], 16)]
        return "".join(chr(c) if c < 0x110000 and not 0xD800 <= c < 0xE000 else UNKNOWN for c in codes)
    if base[1:] in ACCENTS and base[0].isalpha():
        try:
            return unicodedata.lookup(f"LATIN {'CAPITAL' if base[0].isupper() else 'SMALL'} LETTER {base[0].upper()} WITH {ACCENTS[base[1:]]}")
        except KeyError:
            return UNKNOWN
    return UNKNOWN
