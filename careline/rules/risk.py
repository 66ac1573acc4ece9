"""Risk categories of the default rule pack."""

from careline.rules.text import fields, lines, words

# Levels, lowest first.
LEVELS = ["low", "medium", "high", "critical"]
LEVEL_NAMES = ["낮음", "중간", "높음", "긴급"]

# Category ; base level ; keywords ; description ; recommendation ;
# display name ; query expansion.
CATEGORIES = [
    dict(
        category=r[0], level=r[1], keywords=words(r[2]), description=r[3],
        recommendation=r[4], display=r[5], expansion=r[6],
    )
    for r in fields("""
chronic_disease ; high ; 당뇨, 혈당, 혈압, 고혈압, 저혈압, 심장, 콜레스테롤, 관절염, 골다공증, 신장, 간, 폐, 천식, 암 ; 만성질환 관련 증상이 감지되었습니다. ; 정기적인 건강 검진과 의사 상담을 권장합니다. ; 만성질환 ; 만성질환 관리 치료
sleep_disorder ; medium ; 불면, 잠, 수면, 새벽, 뒤척, 수면제, 악몽, 낮잠, 졸음, 피곤, 피로, 기상, 수면무호흡 ; 수면 관련 문제가 감지되었습니다. ; 규칙적인 수면 습관과 수면 환경 개선을 권장합니다. ; 수면 ; 수면 개선 불면증
fall_risk ; high ; 넘어, 낙상, 미끄러, 쓰러, 어지럽, 현기증, 균형, 다리, 걸음, 비틀, 골절, 멍 ; 낙상 위험 신호가 감지되었습니다. ; 이동 시 주의하시고, 필요시 보조 기구 사용을 고려하세요. ; 낙상 위험 ; 낙상 예방 안전
nutritional ; medium ; 식욕, 입맛, 밥, 식사, 체중, 살, 영양, 구토, 소화, 체하다, 탈수, 변비, 설사 ; 영양 및 식이 관련 문제가 감지되었습니다. ; 균형 잡힌 식단과 충분한 수분 섭취를 권장합니다. ; 영양 ; 영양 식이 관리
pain ; medium ; 아프, 통증, 쑤시, 결리, 저리, 두통, 복통, 허리, 무릎, 어깨, 목, 관절통, 신경통 ; 통증 관련 증상이 감지되었습니다. ; 통증이 지속되면 전문의 상담을 권장합니다. ; 통증 ; 통증 완화 관리
emotional ; medium ; 우울, 슬프, 불안, 걱정, 외롭, 무기력, 스트레스, 화나, 짜증, 눈물, 절망, 두렵, 무섭 ; 정서적 어려움이 감지되었습니다. ; 가까운 사람과 대화하거나 전문 상담을 받아보세요. ; 정서 ; 정서 지원 우울
cognitive ; high ; 기억, 잊어, 깜빡, 헷갈, 혼란, 치매, 건망증, 집중, 인지, 판단, 방향, 길 ; 인지 기능 관련 증상이 감지되었습니다. ; 인지 기능 평가와 전문의 상담을 권장합니다. ; 인지 ; 인지 훈련 치매 예방
medication ; medium ; 약, 복용, 처방, 부작용, 약물, 주사, 치료, 복약, 투약, 알레르기, 과량 ; 약물 관련 문제가 감지되었습니다. ; 약 복용 시간과 용량을 확인하고, 이상 반응시 의사와 상담하세요. ; 약물 ; 약물 복용 관리
hygiene ; low ; 목욕, 샤워, 세수, 양치, 옷, 청소, 위생, 화장실, 소변, 대변, 기저귀 ; 일상 위생 관련 사항이 감지되었습니다. ; 규칙적인 위생 관리 루틴을 유지하세요. ; 위생 ; 일상생활 지원
emergency ; critical ; 가슴, 호흡, 숨, 의식, 경련, 마비, 출혈, 응급, 119, 구급 ; 응급 상황 가능성이 감지되었습니다! ; 즉시 119에 연락하거나 보호자에게 알리세요. ; 응급 ; 응급 처치 대응
""", sep=";")
]

# Patterns that raise and patterns that lower the level.
RAISING = lines(r"""
안\s*(좋|되|나아|먹|자|움직)
못\s*(자|먹|움직|걷)
(많이|자꾸|계속|심하게)\s*
(어제|오늘|요즘|최근)\s*(부터|들어)
\d+\s*(일|번|회|시간)
""")
LOWERING = lines(r"""
(좋아|나아|괜찮|편해|잘)
(없|안)\s*(아프|통증|문제)
""")

# Summary wording.
SUMMARY_NONE = "건강 관련 특이 사항이 감지되지 않았습니다."
SUMMARY_LEVEL = "전체 위험 수준: "
SUMMARY_AREAS = "감지된 영역: "
SUMMARY_CRITICAL = "\n⚠️ 긴급 상황이 감지되었습니다. 즉시 조치가 필요합니다."

# Limits of the analysis record.
CONTEXT_CHARS = 200
REPORT_TERMS = 10
QUERY_TERMS = 5
QUERY_SIGNALS = 3
