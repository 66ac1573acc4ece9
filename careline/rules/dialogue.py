"""Transcript, cleaning and prompt rules of the default rule pack."""

from careline.rules.text import fields, lines, words

# Role words by role; a role word may be part of the label.
USER_ROLES = words("고령자, 어르신, 이용자, user")
ASSISTANT_ROLES = words("상담사, 관리사, 건강관리사, agent, assistant")
# Exact speaker names.
USER_SPEAKERS = words("patient, user, 환자")
ASSISTANT_SPEAKERS = words("caregiver, assistant, 생활지원사, AI")

# Label before a turn in a transcript.
ROLE_LABEL = (
    "(?:^|\\n)[•·]?\\s*"
    "(system|고령자|어르신|이용자|상담사|관리사|건강관리사|user|agent|assistant)"
    "\\s*(?:\\([^)]*\\))?\\s*[:：]\\s*"
)
SECTION_MARK = "<[^>]+>|\\[사례|\\[상황"

# Section headings, tried in this order.
ANGLE_HEADING = "<[^>]+>"
BRACKET_HEADING = "\\[(?:사례|상황)\\s*\\d+[^\\]]*\\]"
CASE_HEADING = "사례\\s*\\d+\\s*[:：]"
SYSTEM_HEADING = "System\\s*(?:\\([^)]*\\))?\\s*[:：]"

# Line labels of counselling transcripts.
LINE_USER = "^(User|고령자|이용자)\\s*[:：]\\s*(.+)"
LINE_ASSISTANT = "^(Assistant|Agent|상담사)\\s*[:：]\\s*(.+)"
LINE_SYSTEM, LINE_PERSONA = "System", "페르소나"

# Text cleaning. Stray letters first, then placeholders in order.
STRAY_LETTERS = "[ᄀ-ᅟᅠ-ᆿㄱ-ㅎㅏ-ㅣ]"
PLACEHOLDERS_V1 = lines(r"""
\[검색[^\]]*\]
\[데이터베이스검색\]
""")
PLACEHOLDERS_V2 = PLACEHOLDERS_V1 + lines(r"""
\[검색해서[^\]]*\]
\[응답에 따라서[^\]]*\]
\[약 종류[^\]]*\]
""")
MARKERS = r"\?\?+"

# Model artefacts as pattern ; replacement, applied in order.
ARTIFACTS = [(p, r) for p, r in fields(r"""
(?s)<think>.*?</think> ;
</?think> ;
</?tool_call[^>]*> ;
</?\|+[^<>]*?\|+> ;
(?i)<[/|]*\s*(?:im[\s_]*(?:end|start)|endoftext|email[\s_]*address|im[\s_]*email[\s_-]*end)\s*[/|]*>? ;
(?:가벼운|후속|추가|간단한)?\s*질문\s*[:：]\s* ;
(?i)\n\s*(?:user|assistant|system)\s*$ ;
\n\s*(?:사용자|AI|이용자|건강상담사|어르신)\s*[:：]?\s*$ ;
(?i)<NAME>\s*\(([^)]*)\) ; $1
(?i)<NAME>\s* ;
""", sep=" ;")]
LEADING_ARTIFACTS = lines(r"""
^\[[-\d]*\]\s*
^:\s*
""")

# System prompts and instruction wording of training samples.
SYSTEM_PROMPT = (
    "너는 노인건강전문상담사로서 어르신의 건강 고민에 공감하며 일상에서 실천할 수 있는 "
    "건강 습관을 알려주고, 증상이 심각한 경우 의사 진료를 권유한다."
)
CARE_PROMPT = (
    "당신은 치매노인을 돌보는 따뜻하고 친절한 AI 도우미입니다. \n"
    "항상 존댓말을 사용하고, 천천히 명확하게 설명합니다.\n"
    "복잡한 내용은 짧고 간단한 문장으로 나눠서 전달합니다.\n"
    "환자의 감정을 존중하고 공감하며 대화합니다."
)
PATIENT_LABEL = "환자 정보: "
INSTRUCTION = (
    "치매노인을 돌보는 AI 도우미로서, 다음 질문에 따뜻하고 친절하게 답변하세요. "
    "항상 존댓말을 사용하고, 간단명료하게 설명합니다."
)
COMBINED_SUFFIX = "_합성"

# Wording of the assembled context.
CTX_NO_PROFILE, CTX_BASIC_PROFILE = "등록된 환자 정보가 없습니다.", "기본 정보만 등록됨"
CTX_NO_HISTORY, CTX_NO_DOCS = "이전 대화 없음", "관련 의료 정보 없음"
CTX_USER, CTX_AI = "사용자", "AI"

# Sentence ends (mark, what follows), and the flush rule for long text.
SENTENCE_END = (r"(?<!\d)[.!?…]", r"(?=\s|\z)")
FLUSH_CHARS = 80
SPOKEN_CHARS = 240
