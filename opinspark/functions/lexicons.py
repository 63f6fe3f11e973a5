"""Word lists and patterns. They must equal the ones in use for right results."""

POSITIVE = (
    "хорош", "отлич", "супер", "прекрасн", "замечательн", "идеальн", "удоб", "комфорт", "эмоциональн", "качеств", "прият",
    "эффектив", "быстр", "шикарн", "классн", "выгод", "легк", "надёжн", "стабильн", "аккуратн", "ярк", "прост", "полезн",
    "доступн", "современ", "красив", "чист", "функциональн", "прият", "прочные", "эргономичн", "экономичн", "вкусн", "нрав",
    "рекоменд", "окуп", "поразил", "великолеп", "а++++", "добр", "устроил", "удовлетвор",
)
NEGATIVE = (
    "плох", "ужасн", "безобразн", "отврат", "разочарова", "катастроф", "жаль", "досад", "раздраж", "медлен", "неудоб", "скуч",
    "слишком", "слож", "лома", "слом", "брак", "дефект", "проблем", "глюч", "требует", "дорог", "низк", "полом", "грязн",
    "шумн", "некачеств", "неприят", "устал", "обман", "ненадёжн", "слаб", "разбит", "треснут", "испорт", "теря", "грел",
    "опасн", "раздраж", "подвод", "долг", "устаревш", "огранич", "отказ", "запах", "завис", "теряются", "трудн",
)
KEYPHRASE_STOP = (
    "и", "в", "во", "на", "по", "к", "с", "у", "о", "об", "для", "не", "нет", "это", "как", "что", "все", "всё", "а", "но",
)
STOP_WORDS = (
    "в", "во", "на", "за", "из", "к", "ко", "от", "до", "по", "о", "об", "про", "с", "со", "у", "при", "для", "без", "над",
    "под", "перед", "между", "через", "и", "а", "но", "да", "или", "либо", "что", "чтобы", "когда", "если", "хотя", "потому",
    "поэтому", "так", "как", "будто", "словно", "точно", "не", "ни", "бы", "же", "ли", "ведь", "вот", "вон", "даже", "именно",
    "только", "лишь", "почти", "уже", "ещё", "еще", "разве", "неужели", "я", "ты", "он", "она", "оно", "мы", "вы", "они",
    "мне", "тебе", "ему", "ей", "нам", "вам", "им", "меня", "тебя", "его", "её", "нас", "вас", "их", "мой", "твой", "свой",
    "наш", "ваш", "этот", "тот", "такой", "какой", "который", "чей", "сам", "самый", "весь", "всё", "все", "каждый", "любой",
    "кто", "где", "куда", "откуда", "почему", "зачем", "очень", "совсем", "вообще", "просто", "тоже", "также", "здесь", "тут",
    "там", "везде", "нигде", "где-то", "сейчас", "теперь", "тогда", "всегда", "никогда", "иногда", "быть", "есть", "был",
    "была", "было", "были", "будет", "будут", "это", "эта", "эти", "этих", "этого", "этой", "этому", "то", "того", "тому",
    "том", "той", "тех", "тем", "один", "одна", "одно", "одни", "можно", "нужно", "надо", "нельзя",
)
DETAIL = (
    "например", "конкретно", "особенно", "преимущество", "недостаток", "во-первых", "во-вторых", "главное", "плюс", "минус",
    "достоинство", "качество",
)
EXPERIENCE = ("месяц", "неделю", "дней", "дня", "часов", "руб", "₽", "купил", "заказал", "достав")
GENERIC_STARTERS = ("в целом", "по ощущениям", "для ежедневного использования", "есть небольшие нюансы", "за свою цену")
GENERIC_TOKENS = ("хороший", "плохой", "норм", "нормальный", "качество", "товар", "отзыв", "рекоменд", "стоит")
DURATION = ("месяц", "неделю", "полгода", "недели", "дней", "дня")
DURATION_TYPED = ("месяц", "неделю", "полгод", "недел", "дней", "дня")

EMAIL = r"[\w.+-]+@[\w.-]+\.\w+"
PHONE = r"(\+?\d[\d\s\-]{8,}\d)"
MANY_DIGITS = r"\d.*\d.*\d.*\d"
UNSAFE = (
    r"(полгода|3\s*месяц|неделю|достав|за\s*\d+\s*дн|руб|₽|\d{4}-\d{2}|"
    r"сломался|через\s*неделю|лучший\s*товар|на\s*рынке)"
)
DATE = r"\d{1,2}\.\d{1,2}\.\d{2,4}"
SPECIFIC = r"\d+\s*(руб|₽|месяц|недел|дн|дней|час)|достав|заказ|купил"

# How readers of a category are addressed, by the first key that the category holds, in this order. Fixed values.
READERS = {
    "услуги": "клиенты", "отель": "гости", "отели": "гости", "гостиница": "гости", "гостиницы": "гости",
    "хостел": "гости", "хостелы": "гости", "апартаменты": "гости", "квартира": "гости", "дом отдыха": "гости",
    "медицинская клиника": "пациенты", "клиника": "пациенты", "больница": "пациенты", "поликлиника": "пациенты",
    "стоматология": "пациенты", "медцентр": "пациенты", "медицинский центр": "пациенты", "лечение": "пациенты",
    "терапия": "пациенты", "ресторан": "посетители", "рестораны": "посетители", "кафе": "посетители",
    "бар": "посетители", "бары": "посетители", "столовая": "посетители", "быстрое питание": "посетители",
    "салон красоты": "клиенты", "парикмахерская": "клиенты", "спа": "клиенты", "spa": "клиенты", "массаж": "клиенты",
    "косметология": "клиенты", "маникюр": "клиенты", "педикюр": "клиенты", "автосервис": "клиенты", "сто": "клиенты",
    "автомойка": "клиенты", "шиномонтаж": "клиенты", "аренда автомобилей": "клиенты", "школа": "учащиеся",
    "курсы": "учащиеся", "университет": "студенты", "институт": "студенты", "колледж": "студенты",
    "репетитор": "учащиеся", "магазин": "покупатели", "супермаркет": "покупатели", "торговый центр": "покупатели",
    "бутик": "покупатели", "банк": "клиенты", "банки": "клиенты", "страховая": "клиенты", "мфо": "клиенты",
    "такси": "пассажиры", "авиакомпания": "пассажиры", "автобус": "пассажиры", "поезд": "пассажиры",
    "турагенство": "туристы", "туристические агентства": "клиенты", "туристическое агенство": "туристы",
    "туристическая компания": "туристы", "тур оператор": "туристы", "туроператор": "туристы", "турфирма": "туристы",
    "туристическая фирма": "туристы", "путешествия": "туристы", "туры": "туристы", "экскурсии": "туристы",
    "отдых": "туристы", "кинотеатр": "зрители", "театр": "зрители", "концерт": "зрители", "музей": "посетители",
    "парк развлечений": "посетители", "боулинг": "посетители", "каток": "посетители", "спортзал": "посетители",
    "фитнес": "посетители", "бассейн": "посетители", "йога": "участники",
}
READERS_DEFAULT = "пользователи"

# The stub method's sentences and key phrases.
STUB = {
    "overall": "Это тестовая суммаризация %d отзывов. В реальном методе здесь будет результат работы алгоритма суммаризации.",
    "neutral": "Проанализировано %d отзывов. Пользователи отмечают как положительные, так и отрицательные стороны продукта.",
    "pros": "Основные плюсы по мнению пользователей: %s...",
    "no_pros": "Пользователи отмечают качество продукта и соотношение цена/качество.",
    "cons": "Основные минусы по мнению пользователей: %s...",
    "no_cons": "Некоторые пользователи отмечают отдельные недостатки, требующие внимания.",
}
STUB_PHRASES = (
    ("хорошее качество", "positive", 5, 0.25),
    ("быстрая доставка", "positive", 3, 0.15),
    ("соответствует описанию", "neutral", 4, 0.20),
    ("мелкие недочёты", "negative", 2, 0.10),
)
