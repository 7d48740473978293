"""Common function words of each language, and the spellings of language names in metadata."""

LANGUAGES = ("en", "de", "fr", "es", "pt", "nl", "ru")

COMMON_WORDS = {
    "en": "the of and a to in is that which it with as at be for on by from an are this so has can here was not or its".split(),
    "de": "der die das und in den von mit ist bei dem ein eine auf zu im für dass sich nicht es wird sind auch nach über einem einer hat wenn".split(),
    "fr": "le la les de des du un une et à en que qui est par dans sur pour avec ne pas il se ou au ce cette peut sont été cela".split(),
    "es": "el la los las de del un una y en que se es por con para no al su como está lo más puede ha si a o sobre también".split(),
    "pt": "o a os as de da do dos um uma e em que se é por com para não ao no na como sem mais pode foi são à quando também".split(),
    "nl": "de het een van en in is dat die te op met voor aan zijn er bij niet om ook als door wordt over naar uit tot kan zo zodat".split(),
    "ru": "и в на с что не по как из к от для при его это так то за у о но же до или над во со чтобы который которая если".split(),
}

LANGUAGE_NAMES = {
    "en": "en eng english englisch anglais inglés ingles inglês engels английский".split(),
    "de": "de deu ger german deutsch allemand alemán aleman alemão duits немецкий".split(),
    "fr": "fr fra fre french französisch franzoesisch français francais francés frances francês frans французский".split(),
    "es": "es spa spanish spanisch espagnol español espanol espanhol castellano spaans испанский".split(),
    "pt": "pt por portuguese portugiesisch portugais portugués portugues português portugees португальский".split(),
    "nl": "nl nld dut dutch niederländisch néerlandais neerlandais neerlandés holandés holandês nederlands flemish нидерландский голландский".split(),
    "ru": "ru rus russian russisch russe ruso russo русский".split(),
}
