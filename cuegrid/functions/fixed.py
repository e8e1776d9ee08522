"""Word lists and patterns that results depend on."""

from __future__ import annotations

# Whole lines that recognisers make up over silence, normalised.
MADE_UP_LINES = (
    "a thank you for watching",
    "abone olmayı beğenmeyi ve yorum yapmayı unutmayın",
    "abone olmayı ve videoyu beğenmeyi unutmayın",
    "abone olmayı yorum yapmayı ve beğen butonuna tıklam",
    "abonnez vous à ma chaîne",
    "and subscribe to my channel",
    "bu videoyu beğenmeyi ve kanalımıza abone olmayı unut",
    "críbete al canal gracias",
    "dale like y suscríbete",
    "don t forget to subscribe",
    "ete al canal gracias por ver el video",
    "eu acho que eu vou",
    "gracias por ver el video",
    "gracias por ver el video si te gusto dale like y suscríb",
    "gracias por ver el video si te gusto dale me gusta y sus",
    "gracias por ver el video si te gusto dale un me gusta y",
    "gracias por ver el video si te gusto el video dale me",
    "gracias por ver el video si te gustó dale like y suscr",
    "gracias por ver el video suscríbete al canal",
    "gracias por ver el vídeo",
    "gracias por ver el vídeo suscríbete al canal",
    "gracias por ver este video",
    "grazie per la visione",
    "gusta y suscríbete al canal gracias por ver el video",
    "hallo zusammen und willkommen auf meinem kanal",
    "hello everyone welcome to my channel",
    "hi guys welcome back to my channel",
    "i m not sure if this is the right way to do it but i m not sure if this",
    "inscreva se no canal",
    "kanalıma abone olmayı ve videoyu beğenmeyi unutmayın",
    "kanalıma abone olmayı yorum yapmayı ve beğen butonuna",
    "merci d avoir regardé cette vidéo",
    "merci d avoir regardé cette vidéo abonne toi pour d",
    "merci d avoir regardé cette vidéo merci à bientôt",
    "muchas gracias por ver",
    "n oubliez pas de vous abonner",
    "non dimenticare di iscriverti",
    "não se esqueça de se inscrever",
    "obrigado por assistir se inscreva no canal e ative o sin",
    "please subscribe and like thanks for watching",
    "please subscribe to my channel thank you",
    "se inscreva no canal ative notificações e ative notificações",
    "se inscreva no canal e ative as notificações",
    "se inscreva no canal e ative o sininho",
    "se inscreva no canal e ative o sininho para receber notific",
    "sottotitoli e revisione a cura di qtss",
    "subtitles by the amara org community",
    "suscríbete a mi canal",
    "thank you for watching",
    "thank you for watching please subscribe",
    "thanks for watching please subscribe",
    "welcome to my channel",
    "é isso aí valeu",
    "всем привет и добро пожаловать на мой канал",
    "канал субтитры сделал dimatorzok",
    "на наш канал спасибо",
    "на наш канал спасибо за прос",
    "подписывайтесь на мой канал",
    "подписывайтесь на наш канал",
    "подпишись на канал ставь лайк ж",
    "подпишись на канал ставь лайк и",
    "подпишись на канал субтитры",
    "підписуйтесь на наш канал",
    "редактор субтитров а семкин",
    "редактор субтитров а семкин кор",
    "спасибо за субтитры алексею дуб",
    "ставьте лайки и подписывайтесь",
    "ご視聴ありがとうございました",
    "ご視聴ありがとうございます",
    "チャンネル登録お願いします",
    "字幕提供者 李宗盛",
    "字幕由 amara org 社群提供",
    "字幕由amara org社区提供",
    "感谢收看 欢迎订阅我的频道",
    "由 amara org 社群提供的字幕",
    "見てくれてありがとう",
    "謝謝觀看 下次見",
    "请不吝点赞 订阅 转发 打赏支持明镜与点点栏",
    "구독 부탁드려요",
    "구독과 좋아요 부탁드려요",
    "구독과 좋아요는 사랑입니다",
    "시청해 주셔서 감사합니다",
    "시청해주셔서 감사합니다",
    "시청해주셔서 감사합니다 구독 좋아요 댓글",
    "영상편집 및 자막을 사용하였습니다",
    "오늘도 시청해주셔서 감사합니다",
    "오늘도 영상 봐주셔서 감사합니다 구독과",
    "자막제작 기획 앤디 퀸즈",
    "채널 구독 부탁드립니다",
)

# Line fragments of the same kind.
MADE_UP_FRAGMENTS = ("한글", "자막", "광고", "포함하고 있습니다", "subtitles", "subtitle", "субтитры")

# Patterns of the same kind, without those that need a script class.
MADE_UP_PATTERNS = (
    r"(?i)자막[은는이가]?\s*(제공|출처|by|설정)",
    r"한글\s*자막",
    r"광고를?\s*포함",
    r"구독\s*(과|와|,)?\s*좋아요",
    r"시청해\s*주셔서\s*감사",
    r"(?i)\bsubtitles?\s+(by|provided\s+by)\b",
    r"(?i)\bthanks?\s+for\s+watching\b",
    r"(?i)\bplease\s+subscribe\b",
    r"(?i)субтитры\s+(сделал|подготовил|предоставл)",
    r"(?i)спасибо\s+за\s+просмотр",
    r"(?i)\b(?:https?://|www\.)\S+",
)

# A line that only names a sound.
NON_SPEECH = r"(?i)^\s*[\[(<*]?\s*(music|sounds?|noise|applause|laughter|silence|blank[_ ]audio|inaudible|foreign|no speech)[^\])>*]*[\])>*]?[\s.!?]*$"

# Short forms by gender, male and female.
SHORT_FORMS = (
    ("должен", "должна"), ("рад", "рада"), ("готов", "готова"), ("уверен", "уверена"), ("сам", "сама"), ("один", "одна"), ("виноват", "виновата"), ("прав", "права"), ("обязан", "обязана"),
    ("согласен", "согласна"), ("вынужден", "вынуждена"), ("зол", "зла"), ("болен", "больна"), ("счастлив", "счастлива"), ("свободен", "свободна"), ("голоден", "голодна"), ("занят", "занята"),
    ("удивлён", "удивлена"), ("благодарен", "благодарна"), ("влюблён", "влюблена"), ("ранен", "ранена"), ("способен", "способна"), ("доволен", "довольна"), ("знаком", "знакома"), ("жив", "жива"),
    ("нужен", "нужна"), ("спокоен", "спокойна"), ("напуган", "напугана"), ("измотан", "измотана"),
)
# Past tenses that no suffix rule gives, the prefixes they take, and words of their own.
PAST_STEMS = (
    ("шёл", "шла"), ("шел", "шла"), ("мог", "могла"), ("лёг", "легла"), ("лег", "легла"), ("умер", "умерла"), ("нёс", "несла"), ("нес", "несла"), ("вёз", "везла"), ("вёл", "вела"), ("рос", "росла"), ("тёр", "тёрла"),
    ("пёк", "пекла"), ("лез", "лезла"), ("полз", "ползла"), ("жёг", "жгла"), ("мёрз", "мёрзла"), ("мерз", "мерзла"), ("брёл", "брела"), ("цвёл", "цвела"), ("плёл", "плела"),
)
PAST_PREFIXES = ("", "с", "по", "вы", "при", "у", "за", "на", "от", "ото", "пере", "до", "об", "обо", "под", "подо", "про", "раз", "разо", "из", "изо", "в", "во", "вз", "со")
PAST_WORDS = (
    ("спас", "спасла"), ("запер", "заперла"), ("отпер", "отперла"), ("берёг", "берегла"), ("уберёг", "уберегла"), ("сберёг", "сберегла"), ("привык", "привыкла"), ("отвык", "отвыкла"), ("исчез", "исчезла"),
    ("достиг", "достигла"), ("постиг", "постигла"),
)
NOT_VERBS = ("стол", "пол", "зал", "угол", "гол", "мел", "ствол", "котёл", "посол", "осёл", "козёл", "орёл", "узел", "вол", "мол", "скала", "школа", "сила", "пила", "игла")

# Languages as (growth of a translation, what joins words, characters of a cue's line, reading speed, ends of sentences).
_LATIN = (2.0, " ", 42, 17, ".!?…")
_CJK = (5.0, "", 18, 9, ".!?…。！？")
LANGUAGES = {
    "en": _LATIN,
    "ru": (2.5, *_LATIN[1:]),
    "de": _LATIN,
    "fr": _LATIN,
    "es": _LATIN,
    "it": _LATIN,
    "pt": _LATIN,
    "pl": _LATIN,
    "tr": _LATIN,
    "uk": _LATIN,
    "ko": (3.0, " ", 20, 12, ".!?…。！？"),
    "zh": _CJK,
    "ja": _CJK,
    "th": (3.0, "", 35, 12, ".!?…。！？"),
}

# Words that do not end a cue's line.
CLINGING = ("a", "an", "the", "and", "or", "but", "of", "to", "in", "on", "at", "for", "with", "from", "as", "by", "is", "it",
            "и", "а", "но", "в", "во", "на", "с", "со", "к", "ко", "о", "об", "от", "до", "из", "за", "по", "у", "не", "ни", "что", "как", "же", "бы", "ли", "при", "для", "под", "над", "без", "про")
