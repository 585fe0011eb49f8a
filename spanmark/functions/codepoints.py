"""Named code points and character classes. Fixed values, given as code points and never typed as script."""

BOM, ZWSP, ZWJ = "﻿", "​", "‍"
HAMZA, ALEF_MADDA, ALEF_HAMZA, ALEF, WAW, YEH, LAM, TEH, TAH = "ء", "آ", "أ", "ا", "و", "ي", "ل", "ت", "ط"
BEH, NOON, MEEM, REH = (chr(c) for c in (0x628, 0x646, 0x645, 0x631))
FATHATAN, DAMMATAN, KASRATAN, FATHA, DAMMA, KASRA, SHADDA, SUKOON = (chr(c) for c in range(0x64B, 0x653))
MADDAH, HAMZA_ABOVE, SUPERSCRIPT_ALEF, TATWEEL, QURANIC_SUKOON = "ٓ", "ٔ", "ٰ", "ـ", "ۡ"
SMALL_MEEM, SMALL_SEEN, SMALL_LOW_SEEN, SMALL_WAW, SMALL_YEH = "ۢ", "ۜ", "ۣ", "ۥ", "ۦ"
SMALL_LOW_MEEM, ALEF_MAQSURA = chr(0x6ED), chr(0x649)
# fixed: the marks that normalisation strips, and the pause and prostration marks
OPTIONAL_MARKS = "".join(map(chr, (0x6E5, 0x6E6, 0x6E2, 0x6ED, 0x6E4, 0x6E7, 0x6E8, 0x6E0, 0x6EA, 0x65C, 0x6EC, 0x654, 0x655, 0x640, 0x6DB, 0x6DC, 0x6E3, 0x653)))
PAUSE_MARKS = "".join(map(chr, (0x6DA, 0x6D7, 0x6D6, 0x6D9, 0x6D8, 0x6DE, 0x6E9)))
DIACRITICS = "".join(map(chr, range(0x64B, 0x653)))
VOWELS = "".join(map(chr, range(0x64B, 0x651)))
STACKED = "".join(map(chr, [*range(0x64B, 0x659), 0x65C, 0x65E, 0x670, 0x6E1, 0x6E2, *range(0x6E4, 0x6E9), 0x6ED, *range(0x8F0, 0x8F3)]))
NEVER_SAKIN = "".join(map(chr, (0x622, 0x625, 0x627, 0x649, 0x671)))
CONSONANTS = "".join(c for c in map(chr, [*range(0x621, 0x63B), *range(0x641, 0x64B)]) if c not in NEVER_SAKIN)
# fixed: white space as one explicit class, since the regex dialects differ on it
WS = "\t\n\x0b\x0c\r \xa0  -     　﻿"
LINE_ENDS = "\n\r  "
NAMED_MARKS = {
    "الألف الخنجرية": SUPERSCRIPT_ALEF,
    "واو صغيرة": SMALL_WAW,
    "ياء صغيرة": SMALL_YEH,
    "علامة المد": MADDAH,
}
# fixed: letters that are not written joined to the next one
NOT_JOINING_ON = "".join(map(chr, (0x621, 0x622, 0x623, 0x624, 0x625, 0x627, 0x629, 0x62F, 0x630, 0x631, 0x632, 0x648, 0x671)))
