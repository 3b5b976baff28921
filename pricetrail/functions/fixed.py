"""Shop facts, markers, labels and patterns that decide results.

Patterns are Java regular expressions. ``(?U)`` makes ``\\s``, ``\\w`` and ``\\b`` Unicode-aware.
"""

# Shops: name and base URL.
MAGNIT = ("Магнит", "https://magnit.ru")
PYATEROCHKA = ("Пятёрочка", "https://5ka.ru")
PEREKRESTOK = ("Перекрёсток", "https://www.perekrestok.ru")

# Host and path fragments that route a URL.
MAGNIT_HOST = "magnit.ru"
PYATEROCHKA_HOST = "5ka.ru"
PEREKRESTOK_HOST = "perekrestok.ru"
CATALOG_PATH = "/catalog/"
PEREKRESTOK_CATALOG_PREFIX = "/cat"

# Product links and product ids inside URLs.
MAGNIT_PRODUCT_PATH = "/product/"
PEREKRESTOK_PRODUCT_PATH = r"/cat/(?:c/)?[0-9]+/p/"
MAGNIT_CATALOG_ID = r"/([0-9]+)(?:[/?-].*)?$"
MAGNIT_PRODUCT_ID = r"/([0-9]+)(?:/)?(?:\?.*)?$"
PEREKRESTOK_ID = r"-([0-9]+)/?$"

# Prices in text.
PRICE_ANY_DECIMALS = r"(?U)([0-9]+(?:[.,][0-9]+)?)\s*₽"
PRICE_TWO_DECIMALS = r"(?U)([0-9]+(?:[.,][0-9]{2})?)\s*₽"
CURRENCY_WORDS = ("₽", "руб.", "руб")

# Names: text after the first price.
PROMO_LABELS = ("По карте", "Товар недели", "Новинка", "Акция", "2 + 1 по карте")
UP_TO_FIRST_PRICE = r"(?sU)^.*?[0-9]+(?:[.,][0-9]+)?\s*₽"
DISCOUNT = r"(?U)-[0-9]+%\s*"
LEADING_PRICE = r"(?U)^[0-9]+(?:[.,][0-9]+)?\s*₽\s*"
RATING_TAIL = r"(?U)[0-9]+(?:[.,][0-9]+)?\s*[·.]?\s*[0-9]+\s*отзыв\w*.*$"
NO_REVIEWS_TAIL = r"(?U)Нет отзывов.*$"

# Names: whole text without prices and labels, in this order.
NAME_ATTRIBUTES = ("aria-label", "title", "data-title")
CLEAN_STEPS = (
    r"(?iuU)цена\s*",
    r"(?iuU)старая цена\s*",
    r"(?U)[0-9]+(?:[.,][0-9]{2})?\s*₽(?:/шт)?",
    r"(?iuU)\b(в наличии много|в корзину|реклама|скидка)\b",
    r"(?iuU)[0-9]+\s+оцен\w+.*$",
)
NOT_IN_STOCK_TEXT = "нет в наличии"
OUT_OF_STOCK_MARK = "outofstock"

# Product page: selectors and JSON-LD keys in order of precedence.
NAME_HEADING_TEST_ID = "v-product-details-name"
NAME_KEYS = ("name", "headline")
ID_KEYS = ("sku", "productID", "productId")
MAKER_CODE_KEYS = ("mpn", "gtin13", "gtin", "gtin14")
PRICE_KEYS = ("price", "lowPrice")
JSON_DEPTH = 512  # documents nested deeper do not decode

# Catalogue JSON: price fields in order of precedence.
CATALOG_PRICE_FIELDS = ("discount", "cpd_promo_price", "cpd_promo_price_from_sum_cart", "regular")

# Captured responses.
CAPTURE_URL_PART = "/api/catalog/"
LOGGED_URL_PARTS = ("5ka.ru", "5d.5ka.ru", "/api/", "catalog")
BLOCK_MARKERS = ("Проблемы со связью", "Проверьте настройки интернета и VPN", "Service_connect@x5.ru")
BLOCK_STATUSES = (403, 429)
PREVIEW_CHARS = 500

# History: a price step counts when it is larger than this, on doubles.
PRICE_STEP = 0.01
