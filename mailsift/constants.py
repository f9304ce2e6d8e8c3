"""Fixed values.

Everything in this module is data, not logic: word lists, patterns, template texts and numeric
constants that results depend on. They are stated as plain text in their natural order.
"""

# --- Fixed values: table layout -------------------------------------------------------------
REQUIRED_COLUMNS = ["email_text", "language", "label"]
LANGUAGES = ["en", "sw", "zh", "ru"]
VALID_LABELS = [0, 1]
MIN_ROWS_EXCLUSIVE = 10

# --- Fixed values: decision and request limits ----------------------------------------------
DECISION_THRESHOLD = 0.5
RISK_THRESHOLD = 0.4
MAX_BATCH_EMAILS = 100
PREVIEW_ROWS = 10
PREVIEW_CHARS = 60

# --- Fixed values: tokens and batches -------------------------------------------------------
MAX_SEQ_LEN = 256
VOCAB_SIZE = 20000
BATCH_SIZE = 32
LOG_LOSS_EPSILON = 1e-7

# --- Fixed values: signal words -------------------------------------------------------------
URGENCY_WORDS = [
    "urgent", "immediately", "asap", "now", "action required", "last chance", "warning",
    "suspend",
]
CREDENTIAL_WORDS = [
    "password", "verify", "login", "credentials", "confirm", "ssn", "cvv", "account number",
    "reset password",
]
SALUTATION_WORDS = [
    "dear customer", "dear valued customer", "dear user", "valued customer", "dear member",
]
ATTACHMENT_WORDS = [
    "attachment", "attached", "invoice", "pdf", ".doc", ".xls", "download",
]
URL_ENDINGS = ["com", "ru", "tk", "cn", "xyz", "info", "ml"]
SUSPICIOUS_ENDINGS = ["tk", "ru", "cn", "ml"]
IMPERSONATION_CUE = "Contains 'From:' header (possible raw email paste)"

# --- Fixed values: (cap, weight) of each scored signal, and the ceiling of the score ---------
URGENCY_CAP, URGENCY_WEIGHT = 3, 0.2
CREDENTIAL_CAP, CREDENTIAL_WEIGHT = 3, 0.25
ATTACHMENT_CAP, ATTACHMENT_WEIGHT = 2, 0.15
SUSPICIOUS_CAP, SUSPICIOUS_WEIGHT = 3, 0.25
SCORE_CEILING = 0.99

# --- Fixed values: recommendation texts -----------------------------------------------------
RISKY_HEADLINE = (
    "⚠️ This email contains multiple phishing indicators. "
    "Do NOT click links or provide credentials."
)
RISKY_STEPS = (
    "- Report the email to your security team or provider.\n"
    "- Do not follow links.\n"
    "- Inspect sender domain carefully."
)
SAFE_HEADLINE = (
    "✅ The email appears low-risk based on quick checks. Still exercise caution."
)
SAFE_STEPS = (
    "- If in doubt, verify with the sender through a different channel.\n"
    "- Avoid entering credentials from email links."
)

# --- Fixed values: template texts -----------------------------------------------------------
PHISHING_TEMPLATES = {
    "en": [
        "Urgent: Verify your {service} account immediately. Click here: {url}",
        "Your {service} password has expired. Update it now: {url}",
        "Suspicious activity detected on your {service} account. Confirm identity: {url}",
        "Dear valued customer, please confirm your {service} login credentials: {url}",
        "WARNING: Your {service} account will be suspended unless you verify: {url}",
        "Action required: Update payment method for your {service} account: {url}",
        "Congratulations! You've won a reward from {service}. Claim it: {url}",
        "Your {service} account has been compromised. Reset password here: {url}",
    ],
    "sw": [
        "Haraka: Thibitisha akaunti yako ya {service}. Bofya hapa: {url}",
        "Neno lako la {service} limepoteza muda wake. Sasisha sasa: {url}",
        "Shughuli isiyo ya kawaida imegundulika kwenye akaunti yako ya {service}: {url}",
        "Tafadhali thibitisha akaunti yako ya {service}: {url}",
        "ONYO: Akaunti yako ya {service} itasimama isipokuwa uthibitishe: {url}",
        "Haraka: Sasisha njia ya malipo kwa akaunti yako ya {service}: {url}",
        "Hongera! Umeshinda zawadi kutoka {service}. Lipia hapa: {url}",
        "Akaunti yako ya {service} imehacked. Sasisha neno lako: {url}",
    ],
    "zh": [
        "紧急：验证您的 {service} 账户。点击此处：{url}",
        "您的 {service} 密码已过期。立即更新：{url}",
        "在您的 {service} 账户上检测到可疑活动。确认身份：{url}",
        "尊敬的客户，请确认您的 {service} 登录凭据：{url}",
        "警告：除非您验证，否则您的 {service} 账户将被暂停：{url}",
        "需要操作：为您的 {service} 账户更新付款方式：{url}",
        "恭喜！您从 {service} 赢得了奖励。立即领取：{url}",
        "您的 {service} 账户已被入侵。在此重置密码：{url}",
    ],
    "ru": [
        "Срочно: Подтвердите свой аккаунт {service}. Кликните здесь: {url}",
        "Ваш пароль {service} истек. Обновите сейчас: {url}",
        "Обнаружена подозрительная активность на вашем аккаунте {service}: {url}",
        "Пожалуйста, подтвердите ваши учетные данные {service}: {url}",
        "ПРЕДУПРЕЖДЕНИЕ: Ваш аккаунт {service} будет заблокирован: {url}",
        "Срочно: Обновите способ оплаты для {service}: {url}",
        "Поздравляем! Вы выиграли приз от {service}. Получите: {url}",
        "Ваш аккаунт {service} взломан. Переустановите пароль: {url}",
    ],
}
LEGITIMATE_TEMPLATES = {
    "en": [
        "Hello, here is your {service} monthly invoice for {month}.",
        "Thank you for using {service}. Here are your account details.",
        "We appreciate your business with {service}. See your receipt below.",
        "Your order from {service} has been shipped and will arrive soon.",
        "Welcome to {service}! Thank you for signing up with us.",
        "Here is your {service} billing information for {month}.",
        "Thank you for contacting {service} support team.",
        "Your {service} subscription has been renewed successfully.",
    ],
    "sw": [
        "Habari, hii ni invoice yako ya kila mwezi kutoka {service} kwa {month}.",
        "Asante kwa kutumia {service}. Hapa kuna maelezo ya akaunti yako.",
        "Tunakubaliana na biashara yako na {service}. Angalia kuitisha chini.",
        "Amri yako kutoka {service} imetumwa na itafika karibuni.",
        "Karibu {service}! Asante kwa kusajili.",
        "Hii ni taarifa ya kukodi kwa {service} kwa {month}.",
        "Asante kwa kuwasiliana na timu ya {service}.",
        "Usajili wako wa {service} umeboreshwa kwa mafanikio.",
    ],
    "zh": [
        "你好，这是您从 {service} 的 {month} 月度发票。",
        "感谢您使用 {service}。以下是您的账户详情。",
        "我们感谢您与 {service} 的业务。请查看下方收据。",
        "您从 {service} 的订单已发货，即将送达。",
        "欢迎来到 {service}！感谢您的注册。",
        "这是您的 {service} {month} 月账单信息。",
        "感谢您联系 {service} 支持团队。",
        "您的 {service} 订阅已成功续订。",
    ],
    "ru": [
        "Здравствуйте, вот ваш счет от {service} за {month}.",
        "Спасибо за использование {service}. Вот ваши реквизиты учетной записи.",
        "Мы ценим вашу деятельность с {service}. См. квитанцию ниже.",
        "Ваш заказ от {service} отправлен и скоро будет доставлен.",
        "Добро пожаловать в {service}! Спасибо за регистрацию.",
        "Вот ваша информация об абонентской плате {service} за {month}.",
        "Спасибо за обращение в службу поддержки {service}.",
        "Ваша подписка на {service} успешно продлена.",
    ],
}
SERVICES = ["PayPal", "Amazon", "Apple", "Google", "Microsoft", "Bank", "Netflix"]
MONTHS = ["January", "February", "March", "April", "May", "June"]
LURE_URLS = [
    "bit.ly/verify2024",
    "tinyurl.com/confirm",
    "short.link/secure",
    "goo.gl/check",
    "am@z0n-verify.ru",
    "payp@l-confirm.tk",
    "g00gle-security.tk",
]

# Names of the arrays of the signal record.
SIGNAL_ARRAYS = [
    "urgency_found", "creds_found", "generic_salutation", "attachments_mentioned", "urls",
    "suspicious_urls", "impersonation_cues",
]
# The URL pattern and the suspicious endings in their plain form.
PLAIN_URL = r"(?i)(https?://\S+|www\\.\S+|\b\S+\.(com|ru|tk|cn|xyz|info|tk|ml)\b)"
PLAIN_ENDING = r"(?i)\.tk\b|\.ru\b|\.cn\b|\.ml\b"

# Text of the report on a table that is not fit for use.
UNFIT_TABLE = "Invalid labels or too few rows"

# --- Our own choices (not given by any outside source) --------------------------------------
# Synonyms for signal words, applied in this order by the synonym augmentation.
SYNONYMS = [
    ("urgent", "pressing"),
    ("immediately", "at once"),
    ("warning", "alert"),
    ("suspended", "disabled"),
    ("password", "passcode"),
    ("verify", "validate"),
    ("login", "sign-in"),
    ("credentials", "access details"),
    ("confirm", "approve"),
]
# Frequent function words used to tell Swahili from English in Latin-script text.
SWAHILI_STOPWORDS = ["ya", "wa", "na", "kwa", "ni", "la", "za", "yako", "hii", "kutoka"]
ENGLISH_STOPWORDS = ["the", "of", "and", "to", "is", "your", "for", "in", "has", "you"]
