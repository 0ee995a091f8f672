"""Letters of other scripts that look like a Latin letter."""

import re
import unicodedata

#: Fixed values, in the order of the Latin letters.
CYRILLIC_LOOKALIKES = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "о": "o",
    "р": "p", "ԛ": "q", "г": "r", "ѕ": "s", "т": "t", "ц": "u", "ѵ": "v", "ԝ": "w", "х": "x", "у": "y", "ү": "y", "ё": "ë", "ї": "ï",
    "А": "A", "В": "B", "С": "C", "Ԁ": "D", "Е": "E", "Ԍ": "G", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O",
    "Р": "P", "Ԛ": "Q", "Ѕ": "S", "Т": "T", "Ѵ": "V", "Ԝ": "W", "Х": "X", "У": "Y", "Ү": "Y", "З": "3", "Ё": "Ë", "Ї": "Ï",
}
GREEK_LOOKALIKES = {
    "α": "a", "ϲ": "c", "ε": "e", "η": "n", "ι": "i", "ϳ": "j", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "σ": "o", "τ": "t", "υ": "u", "χ": "x", "γ": "y", "ω": "w",
    "Α": "A", "Β": "B", "Ϲ": "C", "Ε": "E", "Η": "H", "Ι": "I", "Ϳ": "J", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ζ": "Z",
}
OTHER_LOOKALIKES = {"ı": "i", "ɑ": "a", "ɡ": "g", "ա": "w", "օ": "o", "ո": "n", "ս": "u", "ց": "g", "հ": "h"}
#: Letters of further scripts by the shape of a Latin capital or small letter.
LISU_LOOKALIKES = {
    "ꓐ": "B", "ꓑ": "P", "ꓓ": "D", "ꓔ": "T", "ꓖ": "G", "ꓗ": "K", "ꓙ": "J", "ꓚ": "C", "ꓜ": "Z", "ꓝ": "F", "ꓟ": "M", "ꓠ": "N", "ꓡ": "L", "ꓢ": "S",
    "ꓣ": "R", "ꓦ": "V", "ꓧ": "H", "ꓪ": "W", "ꓫ": "X", "ꓬ": "Y", "ꓮ": "A", "ꓰ": "E", "ꓲ": "I", "ꓳ": "O", "ꓴ": "U",
}
CHEROKEE_LOOKALIKES = {
    "Ꭰ": "D", "Ꭱ": "R", "Ꭲ": "T", "Ꭵ": "i", "Ꭹ": "y", "Ꭺ": "A", "Ꭻ": "J", "Ꭼ": "E", "Ꮃ": "W", "Ꮇ": "M", "Ꮋ": "H", "Ꮍ": "Y", "Ꮐ": "G", "Ꮒ": "h", "Ꮓ": "Z",
    "Ꮟ": "b", "Ꮢ": "R", "Ꮤ": "W", "Ꮥ": "S", "Ꮩ": "V", "Ꮪ": "S", "Ꮮ": "L", "Ꮯ": "C", "Ꮲ": "P", "Ꮶ": "K", "Ꮷ": "d", "Ᏻ": "G", "Ᏼ": "B",
}
COPTIC_LOOKALIKES = {
    "Ⲁ": "A", "Ⲃ": "B", "Ⲉ": "E", "Ⲏ": "H", "Ⲓ": "I", "Ⲕ": "K", "Ⲙ": "M", "Ⲛ": "N", "Ⲟ": "O", "Ⲣ": "P", "Ⲥ": "C", "Ⲧ": "T", "Ⲩ": "Y", "Ⲭ": "X", "ⲟ": "o", "ⲣ": "p", "ⲥ": "c", "ⲭ": "x",
}
ARMENIAN_LOOKALIKES = {"Ս": "U", "Տ": "S", "Օ": "O", "Լ": "L", "զ": "q", "ս": "u", "օ": "o", "ո": "n", "հ": "h", "ց": "g", "ա": "w"}
LOOKALIKES = CYRILLIC_LOOKALIKES | GREEK_LOOKALIKES | OTHER_LOOKALIKES | LISU_LOOKALIKES | CHEROKEE_LOOKALIKES | COPTIC_LOOKALIKES | ARMENIAN_LOOKALIKES


def named_letters() -> dict[str, str]:
    """Latin letters for the other letters of Cyrillic, Greek, Coptic and Armenian, by their Unicode names.

    A letter's name begins with its sound, or has it after an E (as in DE, EL, LAMDA); signs
    that are named otherwise have none.
    """
    found = {}
    for first, last in ((0x370, 0x52F), (0x531, 0x586), (0x1C80, 0x1C88), (0x1F00, 0x1FFC), (0x2C80, 0x2CB1)):
        for c in map(chr, range(first, last + 1)):
            m = _NAME.match(unicodedata.name(c, ""))
            if m and c not in LOOKALIKES:
                sound = m["name"]
                letter = sound[1] if len(sound) == 2 and sound[0] == "E" else sound[0]
                found[c] = letter.lower() if m["case"] == "SMALL" else letter
    return found


_NAME = re.compile(r"(?:CYRILLIC|GREEK|COPTIC|ARMENIAN) (?P<case>SMALL|CAPITAL) LETTER (?:(?:SHORT|FINAL|UKRAINIAN|BYELORUSSIAN-UKRAINIAN|OLD COPTIC|DIALECT-P) )?(?P<name>[A-Z]{2,})(?: |$)(?!SIGN)")
