"""Intent rules of the default rule pack."""

from careline.rules.text import lines, words

# Intent names, in the order the cascade tests them.
BLOCKED, EMERGENCY, END, GENERAL = "blocked", "emergency", "end_conversation", "general_chat"
FOLLOWUP, HEALTH, MEDICATION, LIFESTYLE = "followup", "health_consult", "medication", "lifestyle"

# Attempts to read or override the system prompt.
LEAK_WORDS = words("""
시스템 프롬프트, system prompt, 프롬프트를 알려, 프롬프트 알려
지시를 무시, ignore previous, ignore instructions
당신의 지시, 너의 지시, instructions are
프롬프트 내용, 초기 지시, 설정을 알려, 역할을 알려
jailbreak, jail break, 역할극, roleplay as
pretend you are, act as if, act as a
이전 지시를 무시, 규칙을 무시, 규칙을 어겨
""")

# Emergency words.
EMERGENCY_WORDS = words("""
쓰러, 의식, 호흡, 숨을 못, 숨이 안
가슴이 아, 가슴 통증, 심장, 경련, 발작
피를 토, 피가 나, 출혈, 골절, 부러
119, 응급, 구급, 살려, 죽
머리를 부딪, 머리를 다쳤, 머리에서 피
화상, 불에 데, 뜨거운 물
약을 너무 많이, 약 과다, 중독
못 움직, 마비, 감각이 없
갑자기 말을 못, 얼굴이 돌아
""")

# Emotional and relational risk words. Two end in a blank that matters.
EMOTIONAL_RISK_WORDS = words("""
구박, 외롭, 외로워, 쓸쓸, 혼자야, 혼자가
가족이 싫, 가족이 미워, 사이가 안, 사이가 좋지, 사이가 나쁘
말도 안 해, 말을 안 해, 말도 안해, 말을 안해
보러 오지, 찾아오지
""") + ["전화도 안 "] + words("""
전화도 안해
버림받, 버렸어, 기댈 데가 없, 의지할 데가 없
죽고 싶, 살기 싫, 살 의미, 사는 의미, 살아서 뭐
우울, 슬프, 눈물이 나, 울고만
""")

# Health consultation words.
HEALTH_WORDS = words("""
아프, 아파, 통증, 쑤시, 저리, 가려, 붓
두통, 어지러, 메스꺼, 구역질, 설사, 변비
소화가 안, 소화불량, 소화 안 되, 소화가 잘 안
열이, 기침, 콧물, 재채기, 감기, 몸살
숨이 차, 가래, 목이 아
잠을 못, 잠이 안, 불면, 수면, 밤에 깨
새벽에 깨, 잠을 설, 꿈을 많이
당뇨, 혈당, 혈압, 고혈압, 저혈압
관절, 뼈, 근육, 허리, 무릎, 어깨
눈이 침침, 노안, 백내장, 녹내장
귀가 안, 난청, 이명
치매, 건망증, 기억
발톱, 손톱, 피부, 탈모, 구강, 잇몸, 치아
갱년기, 골다공증, 요실금, 변실금
욕창, 구축, 폐, 폐렴
병원, 진료, 검사, 진단, 처방, 치료
증상이, 증세, 상태가
""")

# Medication words.
MEDICATION_WORDS = words("""
약, 복약, 복용, 처방전, 먹는 약
부작용, 약 이름, 약 먹, 약을 안
언제 먹, 몇 알, 식전, 식후
""")

# Lifestyle words ("산책" counts twice).
LIFESTYLE_WORDS = words("""
밥, 식사, 식단, 음식, 영양, 비타민
운동, 산책, 걷기, 체조, 스트레칭
목욕, 씻, 위생
TV, 취미, 여가, 산책
""")

# Patterns that end a conversation.
END_PATTERNS = lines(r"""
(여기까지|이만|그만)\s*(하자|할게|하겠|하죠|합시다|하시죠)
대화\s*(그만|끝|종료|마치|마무리)
(오늘은|이제)\s*(그만|끝|여기까지|마무리)
(그만|끝|종료)\s*(할래|하고 싶|하자|해줘|해 줘|하겠)
(대화를|얘기를|이야기를)\s*(끝|마치|마무리|종료)
(끝내자|끝낼게|끝내겠|마칠게|마치자|마무리하자|종료할게)
(이제\s*)?(그만\s*)?(말|얘기|이야기)\s*(그만|끝|안 할|안할)
(다음에|나중에)\s*(또|다시)\s*(얘기|이야기|봐요|만나|하자)
^(그만|끝|종료|바이)[\s!.~]*$
^(잘 있어|수고했|수고하셨|고생했|고생하셨)
""")

# Patterns of a follow-up question.
FOLLOWUP_PATTERNS = lines(r"""
^(그래서|그러면|그럼|그게|그건)[\s?]
^(어떻게|어떡|뭘|무엇을|뭘|왜|언제|얼마나)[\s?]
^(더|또|다른|추가로|그리고)[\s]
^(그거|그것|이거|저거|그런|이런|저런)\s
^(해야|하면|되나|될까|좋을까|좋아|나아|괜찮)
^(네|응|예|맞아|알겠|그래)\s
^.{1,8}(해야 해|하면 돼|좋아\?|될까|인가요|인가|건가요|건가|할까)
^.{1,6}\?$
""")

# Patterns of everyday talk.
GENERAL_PATTERNS = lines(r"""
^(안녕|반갑|감사|고마|잘 지내|오래간만|오랜만)
^(좋은 아침|좋은 하루|잘 자|잘 잤)
(날씨|오늘|내일|어제|주말|휴일)
^(심심|외로|그리|보고 싶|울적|기분)
^(뭐 해|뭐 하|뭐해|뭐하)
(먹었|먹어|내가 해|나갈 거|가려고|다녀왔|했어)
(비빔밥|밥 먹|점심|저녁|아침 먹|배 부르|배불러)
(산책 나갈|산책 가|산책하|운동하러|걸을 거|나갈 거)
""")

# Confidences of the cascade, and the short-message bound.
CONFIDENCE = dict(
    leak=1.0, emergency=0.95, end=0.9, general=0.8, followup=0.85, followup_short=0.75,
    health_many=0.9, health_one=0.75, medication=0.8, lifestyle_many=0.8,
    lifestyle_one=0.65, short=0.6, default=0.5,
)
SHORT_CHARS = 10

# Intents whose answers carry medical guidance.
GUIDED_INTENTS = [HEALTH, MEDICATION, FOLLOWUP]
REFERRAL_TURN = 3

# Rewriting of follow-up questions.
REWRITE_HOW = "(어떻게|어떡|어째)"
REWRITE_SO = r"^(그래서|그러면|그럼)\s*(.*)$"
REWRITE_SO_DEFAULT = "어떻게 하면 되나요?"
REWRITE_MORE = r"^(더|또|다른|추가로|그리고)\s*(.*)$"
REWRITE_MORE_DEFAULT = "알려주세요"
REWRITE_YES = r"^(네|응|예|맞아|알겠|그래|좋아)\s*(.*)$"
REWRITE_THAT = r"^(그거|그것|그건|이거|저거|그런|이런)\s*(.*)$"
REWRITE_GREETING = (
    "^(안녕|반갑|감사|고마|잘 지내|오래간만|오랜만|"
    "좋은 아침|좋은 하루|잘 자|잘 잤|심심|외로|뭐 해|뭐해)"
)
REWRITE_ABOUT = " 관련해서 "
REWRITE_ON = "에 대해 "
REWRITE_MORE_TELL = "에 대해 더 알려주세요"
