"""Fixed values.

Everything in this module is data that results depend on (word lists, lookup
tables, limits and text formats), kept as plain text in one place.  No logic.
"""

# --- fixed values: labels ---------------------------------------------------
LABELS = ("negative", "neutral", "positive")
NO_COMMENT = "no comment"
MOODS = LABELS + (NO_COMMENT,)
DEFAULT_LABEL = "neutral"
EVALUATION_LABELS = ("positive", "neutral", "negative")

# --- fixed values: sources --------------------------------------------------
SOURCE_VOTED = "gazeta"
SOURCE_REACTIONS = "podrobno"
SOURCE_POSTS = "instagram"
POST_KEY_PREFIX = "insta_"

# --- fixed values: limits ---------------------------------------------------
SHORT_TEXT_CHARS = 12
POST_PROMPT_COMMENTS = 50
ARTICLE_PROMPT_COMMENTS = 5
REPORT_SUMMARIES = 5
REPORT_QUOTES = 10
REPORT_TOP_LABELS = 5
EVALUATION_ROWS = 50
SAMPLE_SEED = 42

# --- fixed values: reaction name -> label -----------------------------------
REACTION_LABELS = {
    "Нравится": "positive",
    "Восхищение": "positive",
    "Радость": "positive",
    "Удивление": "neutral",
    "Подавленность": "negative",
    "Грусть": "negative",
    "Разочарование": "negative",
    "Не нравится": "negative",
}

# --- fixed values: topic keywords -------------------------------------------
KEYWORDS_ENGLISH = (
    "uzbekistan", "tashkent", "government", "mirziyoyev", "reform", "tax", "taxes",
    "economy", "salary", "price", "healthcare", "education", "internet", "protest",
    "explosion", "accident", "fire", "rights", "law", "election", "police", "corruption",
    "job", "jobs", "employee", "employment", "tariffs", "tarif",
)
KEYWORDS_RUSSIAN = (
    "Узбекистан", "Ташкент", "правительство", "Мирзиёев", "реформа", "налог", "налоги",
    "экономика", "зарплата", "цена", "здравоохранение", "образование", "интернет", "протест",
    "взрыв", "авария", "пожар", "права", "закон", "выборы", "полиция", "коррупция",
    "работа", "рабочие места", "работник", "занятость", "тарифы", "тариф",
)
KEYWORDS_UZBEK = (
    "o'zbekiston", "toshkent", "hukumat", "mirziyoyev", "islohot", "soliq", "soliqlar",
    "iqtisod", "maosh", "narx", "sog'liqni saqlash", "ta'lim", "internet", "norozilik",
    "portlash", "avariya", "yong'in", "huquqlar", "qonun", "saylov", "politsiya",
    "korruptsiya", "ish", "xodim", "bandlik", "tariflar", "tarif",
)
KEYWORDS = KEYWORDS_ENGLISH + KEYWORDS_RUSSIAN + KEYWORDS_UZBEK

# --- fixed values: page rules (element, attribute, attribute value) ----------
VOTED_TITLE = ("h1", "id", "article_title")
VOTED_PARAGRAPH = ("p", "dir", "ltr")
VOTED_COMMENT = ("div", "class", "comment-body")
VOTED_COMMENT_AUTHOR = ("h4", "class", "comment-user")
VOTED_COMMENT_UP = ("span", "class", "up-votes-count")
VOTED_COMMENT_DOWN = ("span", "class", "down-votes-count")
VOTED_LINK = "^(?=/ru/).*/2025/"
REACTION_PAGE_TITLE = ("h1", "class", "post-title")
REACTION_PAGE_BODY = ("div", "class", "detail-text")
REACTION_PAGE_COMMENT = ("div", "class", "comment-content")
REACTION_ITEM = ("div", "class", "pc-emotions-item")
REACTION_ITEM_COUNT = (None, "class", "pc-emotions-item-counter")
REACTION_PAGE_LINK = "^/cat/"
REACTION_PAGE_LINK_HEADING = ("h2", "class", "sh-title")
POST_CAPTION = ("h1", "class", "_ap3a")
POST_COMMENT = ("span", "class", "_ap3a")
POST_COMMENT_WITHIN = ("ul", 2)  # a list inside a list
POST_LINK = "/p/"

# --- fixed values: prompt formats -------------------------------------------
POST_PROMPT_HEAD = "Пост:\n    "
POST_PROMPT_COUNT = "\n    \n    Комментарии ("
POST_PROMPT_LIST = "):\n    "
POST_PROMPT_TASK = (
    "\n    \n    Задача:\n"
    "    На основе содержания поста и комментариев составь краткий аналитический обзор"
    " на русском языке. Укажи:\n"
    "    - Основную тему поста\n"
    "    - Общее настроение и реакцию людей\n"
    "    - Конкретные примеры или тенденции, если они есть\n"
    "    \n"
    "    Будьте прямолинейны и прямолинейны в своих выводах и заключениях.\n    "
)
POST_SYSTEM_TEXT = (
    "Ты — аналитик социальных сетей. Делай краткие обзоры на русском языке."
)
POST_ERROR_TEXT = "[ERROR: Не удалось получить ответ от модели]"

ARTICLE_PROMPT_HEAD = "\nСТАТЬЯ:\n"
ARTICLE_PROMPT_LIST = "\n\nКОММЕНТАРИИ:\n"
ARTICLE_PROMPT_TASK = (
    "\n\nСформулируй краткое содержание содержания статьи и основных реакций в"
    " комментариях. Ответ должен быть на русском языке.\n"
)
ARTICLE_SYSTEM_TEXT = (
    "Ты — аналитик СМИ. Напиши краткое содержание и выяви главные темы статьи"
    " и комментариев."
)
ARTICLE_NO_COMMENTS = "Нет комментариев."
ARTICLE_ERROR_HEAD = "[ERROR] "

REPORT_ROLE = (
    "Вы — аналитик Узбекского СМИ про Узбекистан, изучающий общественное мнение по"
    " поводу новостей и комментариев читателей на русском языке, поэтому используйте"
    " только русский язык."
)
REPORT_ORDER = (
    "Напишите **аналитический отчет на русском языке** для представителей государства"
    " на основе следующих данных."
)
REPORT_TASK_HEAD = "Задача:"
REPORT_TASK = (
    "Составьте профессиональный и связный отчет на **русском** языке, в котором вы"
    " проанализируете общее настроение населения по отношению к текущим новостям."
    " Упомяните эмоциональные тенденции, общие темы и возможные причины недовольства или"
    " поддержки. При необходимости переформулируйте или редко процитируйте уместные"
    " пользовательские комментарии."
)
REPORT_SUMMARY_HEAD = "Сводка:"
REPORT_COUNT = "- Количество проанализированных статей: "
REPORT_MOODS = "- Распределение настроения (по статьям):"
REPORT_MOOD_NAMES = {
    "positive": "    - Позитивное: ",
    "neutral": "    - Нейтральное: ",
    "negative": "    - Негативное: ",
    "no comment": "    - Без комментариев: ",
}
REPORT_TOP_REACTIONS = "- Наиболее часто встречающиеся эмоции (по реакциям): "
REPORT_NO_REACTIONS = "(эмоции не определены)"
REPORT_QUOTES_HEAD = "- Примеры комментариев пользователей:"
REPORT_POST_SUMMARIES = "Краткие аналитические сводки по постам Instagram:"
REPORT_POST_SUMMARIES_EMPTY = "Нет Instagram-сводок."
REPORT_POST_SUMMARIES_ABSENT = "Instagram-данные отсутствуют."
REPORT_ARTICLE_SUMMARIES = "Краткие аналитические сводки по статьям СМИ:"
REPORT_ARTICLE_SUMMARIES_EMPTY = "Нет сводок по статьям."
REPORT_ARTICLE_SUMMARIES_ABSENT = "Сводки по статьям отсутствуют."
POST_SENTENCE_HEAD = "Этот пост: "
POST_SENTENCE_MIDDLE = ", вызвал такую реакцию: "
