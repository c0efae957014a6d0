"""Word lists and limits of the text rules."""

# Phrases that say nothing.
EMPTY = (
    "важно отметить", "стоит отметить", "стоит подчеркнуть", "необходимо учитывать", "следует отметить", "в современном мире", "играет важную роль", "является ключевым",
    "ключевым фактором", "комплексный подход", "в рамках данного", "в рамках которого", "представляет собой", "не только, но и", "динамично развивающийся", "инновационный",
    "уникальное решение", "эффективное решение", "синергия", "драйвер роста", "бесшовный", "экосистемный", "в целях повышения", "с целью оптимизации", "оптимизация процессов",
)
# Words that are not used.
BANNED = ("осознанность", "гармония", "ресурсное состояние", "трансформация", "исцеление", "прокачать", "умный алгоритм")
# Nouns that hide an action.
NOMINAL = ("осуществляется", "производится", "выполняется проверка", "имеет место")
# Titles that name a topic and say nothing about it.
TOPICS = (
    "метрики", "риски", "продукты", "статус", "итоги", "обзор", "введение", "заключение", "повестка", "о нас", "о компании", "результаты", "выводы", "числа", "три числа",
    "приоритеты", "план", "бэклог", "разное",
)
# Limits.
SENTENCE_WORDS, BULLETS, BULLET_WORDS, TITLE_MIN, TITLE_MAX, SLIDES = 25, 6, 22, 4, 14, 9
# Kinds that hold prose, and kinds that are evidence by themselves.
PROSE = ("para", "bullets", "note", "sub", "human")
EVIDENCE = ("metrics", "table", "status", "human")
# What counts as an honest gap, and as a meeting that did not take place.
NO_DATA, CANCELLED = ("данных нет", "нет данных"), "несостоявш"
