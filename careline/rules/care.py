"""Schedules, suggestions and scoring words of the default rule pack."""

from careline.rules.text import fields, words

# Default day as activity ; start ; minutes ; description ; required.
ROUTINE = [
    (i, a, int(s[:2]) * 60 + int(s[3:]), int(m), d, req == "yes")
    for i, (a, s, m, d, req) in enumerate(fields("""
wake_up ; 07:00 ; 30 ; 기상 및 세면 ; yes
breakfast ; 08:00 ; 45 ; 아침 식사 ; yes
medication ; 08:30 ; 5 ; 아침 약 복용 ; yes
exercise ; 09:30 ; 30 ; 가벼운 스트레칭 ; yes
walk ; 10:30 ; 30 ; 산책 ; yes
lunch ; 12:00 ; 45 ; 점심 식사 ; yes
medication ; 12:30 ; 5 ; 점심 약 복용 ; yes
nap ; 14:00 ; 60 ; 낮잠 ; no
hobby ; 15:30 ; 60 ; 취미 활동 ; no
dinner ; 18:00 ; 45 ; 저녁 식사 ; yes
medication ; 18:30 ; 5 ; 저녁 약 복용 ; yes
tv ; 19:30 ; 60 ; TV 시청 ; no
bath ; 20:30 ; 30 ; 목욕/씻기 ; yes
sleep ; 21:30 ; 0 ; 취침 ; yes
""", sep=";"))
]

# Hour bands as from ; to ; suggestions. Other hours take the last row.
SUGGESTIONS = [
    (int(a), int(b), [x for x in t.split("/")])
    for a, b, t in fields("""
6 ; 10 ; 창문을 열어 신선한 공기를 마셔보세요 🌅/가벼운 스트레칭으로 몸을 풀어보세요/물 한 잔 마시는 것도 좋아요 💧
10 ; 12 ; 날씨가 좋으면 잠깐 산책 어떠세요? 🚶/좋아하는 음악을 들어보세요 🎵/가족에게 전화해보는 건 어때요? 📞
12 ; 14 ; 맛있는 점심 드셨나요? 🍽️/식후에 잠깐 쉬는 것도 좋아요
14 ; 17 ; 좋아하는 TV 프로그램 시청은 어떠세요? 📺/간단한 퍼즐이나 게임도 좋아요 🧩/따뜻한 차 한 잔 어떠세요? ☕
17 ; 20 ; 저녁 식사 준비 시간이에요 🍽️/하루를 돌아보며 일기를 써보세요 📝
20 ; 6 ; 편안한 음악과 함께 휴식하세요 🎶/잠들기 전 따뜻한 물을 드세요/오늘 하루도 수고하셨어요 💤
""", sep=";")
]
# Parts of the day by hour.
DAY_PARTS = [(5, 12, "아침"), (12, 18, "오후")]
DAY_PART_ELSE = "저녁"

# Reminder window in minutes before and after the set time.
DUE_BEFORE, DUE_WITHIN = 5, 30

# Wording of rolled-up activity ages.
AGE_NOW, AGE_HOURS, AGE_DAYS = "방금 전", "시간 전", "일 전"

# Scoring words of the response quality report.
HONORIFIC_ENDINGS = words("요, 다, 세요, 니다, 습니다, 어요, 아요")
EMPATHY_WORDS = words("이해, 걱정, 힘드, 괴로, 불편, 안타깝, 많이, 그러시, 아이go, 아이고, 속상, 고생, 마음")
FORBIDDEN_PHRASES = words("도움이 되셨, 도움이 되었, 궁금한 점이 있으시면, 추가 질문")
INVASIVE_PHRASES = words("치매입니까, 치매 증상, 요실금이 있으신가요, 우울증이 있으신가요")
ADVICE_WORDS = words("""
수영, 걷기, 산책, 스트레칭, 요가, 자전거
수면, 카페인, 잠자리, 기상, 취침
식이섬유, 물을, 채소, 과일, 영양, 식사
혈압약, 복용, 정기적, 검진, 진료
보조 기구, 지팡이, 미끄럼, 안전
패드, 골반, 케겔
병원, 전문의, 상담
""")
SOFT_ENDINGS = ["?", "요?", "세요.", "세요"]
LIST_PATTERN = r"(?m)^\s*[\d\-\*·•][\.\)]\s"
BOLD_PATTERN = r"\*\*[^*]+\*\*"
NUMBERED_PATTERN = r"(?m)^\s*\d+[\.\)]\s"
MODEL_WORDS = words("어르신, 네, 드세요, 좋아요, 괜찮아요")
HEURISTIC_MARGIN, JUDGE_MARGIN = 0.05, 0.3
TOKENS_PER_CHAR = 2.5
