"""Seed of the health graph and its allow-lists."""

from careline.rules.text import fields, words

# Allowed node labels and relation types.
LABELS = words("Condition, Symptom, Treatment, BodyPart, RiskFactor, Medication, Lifestyle")
RELATIONS = words("SYMPTOM_OF, MANAGED_BY, CAUSES, PREVENTS, AFFECTS, TREATS, RELATED_TO")

# Seed nodes as name ; label ; description.
NODES = fields("""
수면장애 ; Condition ; 고령자 수면 장애
불면증 ; Symptom ; 잠들기 어렵거나 자주 깨는 증상
수면 패턴 변화 ; Symptom ; 수면 주기 변화
주간 졸림 ; Symptom ; 낮에 졸리는 증상
규칙적 수면 습관 ; Treatment ; 일정한 시간 취침/기상
수면 환경 개선 ; Treatment ; 어둡고 조용한 환경, 적정 온도
낮 활동량 증가 ; Treatment ; 낮에 적절한 운동과 활동
카페인 제한 ; Lifestyle ; 오후 카페인 섭취 제한
내향성 발톱 ; Condition ; 발톱이 살 안쪽으로 파고드는 질환
발톱 변형 ; Symptom ; 발톱이 두꺼워지거나 휘는 증상
발톱 통증 ; Symptom ; 발톱 주변 통증, 염증
발톱 관리 ; Treatment ; 올바른 발톱 깎기 (일자로)
편한 신발 ; Treatment ; 발에 맞는 편안한 신발 착용
발 ; BodyPart ;
발톱 무좀 ; Condition ; 발톱 곰팡이 감염
당뇨 ; Condition ; 혈당 조절 이상
고혈당 ; Symptom ; 혈당이 높은 상태
저혈당 ; Symptom ; 혈당이 낮아 어지러움
갈증 ; Symptom ; 심한 갈증
빈뇨 ; Symptom ; 소변을 자주 보는 증상
혈당 모니터링 ; Treatment ; 정기적 혈당 측정
식이 조절 ; Treatment ; 당분 제한, 균형 잡힌 식단
규칙적 운동 ; Lifestyle ; 가벼운 유산소 운동
갱년기 ; Condition ; 호르몬 변화에 의한 증상
안면홍조 ; Symptom ; 얼굴이 갑자기 달아오르는 증상
감정 기복 ; Symptom ; 감정 변화가 심한 상태
호르몬 치료 ; Treatment ; 의사 처방 호르몬 요법
스트레스 관리 ; Lifestyle ; 명상, 이완 등
치주 질환 ; Condition ; 잇몸 질환
잇몸 출혈 ; Symptom ; 잇몸에서 피가 나는 증상
구취 ; Symptom ; 입 냄새
치아 흔들림 ; Symptom ; 치아가 흔들리는 증상
구강 위생 ; Treatment ; 올바른 칫솔질, 치실 사용
정기 치과 검진 ; Treatment ; 6개월마다 치과 방문
구강 ; BodyPart ;
난청 ; Condition ; 청력 저하
소리 안 들림 ; Symptom ; 소리가 잘 안 들리는 증상
이명 ; Symptom ; 귀에서 소리가 나는 증상
보청기 ; Treatment ; 보청기 착용
청력 검사 ; Treatment ; 정기 청력 검사
귀 ; BodyPart ;
말초신경병증 ; Condition ; 말초 신경 손상
손발 저림 ; Symptom ; 손이나 발이 저린 증상
감각 이상 ; Symptom ; 감각이 둔해지는 증상
혈액 순환 개선 ; Treatment ; 가벼운 운동, 마사지
비타민B 보충 ; Treatment ; 비타민B12 등 보충
요실금 ; Condition ; 소변 조절 어려움
소변 실수 ; Symptom ; 의도치 않은 소변 배출
빈뇨감 ; Symptom ; 소변을 자주 보고 싶은 느낌
골반저 운동 ; Treatment ; 케겔 운동 등
배뇨 훈련 ; Treatment ; 정해진 시간 배뇨 습관
방광 ; BodyPart ;
탈모 ; Condition ; 머리카락이 빠지는 상태
머리카락 빠짐 ; Symptom ; 머리카락이 많이 빠지는 증상
두피 관리 ; Treatment ; 두피 청결, 마사지
영양 섭취 ; Treatment ; 단백질, 철분 등 영양소 보충
두피 ; BodyPart ;
폐질환 ; Condition ; 만성 폐쇄성 폐질환 등
만성기침 ; Symptom ; 오래 지속되는 기침
호흡곤란 ; Symptom ; 숨이 차는 증상
가래 ; Symptom ; 가래가 많은 증상
호흡 운동 ; Treatment ; 복식 호흡, 입술 오므리기 호흡
금연 ; Lifestyle ; 흡연 중단
폐 ; BodyPart ;
노인성 피부 ; Condition ; 고령자 피부 건조, 가려움
피부 가려움 ; Symptom ; 피부가 가려운 증상
피부 건조 ; Symptom ; 피부가 건조한 상태
보습제 사용 ; Treatment ; 보습크림 정기 도포
미지근한 물 세안 ; Treatment ; 뜨거운 물 대신 미지근한 물
피부 ; BodyPart ;
욕창 ; Condition ; 오래 누워있어 피부가 손상
피부 발적 ; Symptom ; 피부가 빨갛게 되는 증상
체위 변경 ; Treatment ; 2시간마다 자세 바꾸기
피부 보호 ; Treatment ; 쿠션, 매트리스 사용
변비 ; Condition ; 배변 어려움
배변 곤란 ; Symptom ; 변을 보기 어려운 증상
복부 팽만 ; Symptom ; 배가 더부룩한 증상
수분 섭취 ; Treatment ; 충분한 물 마시기
섬유질 섭취 ; Treatment ; 과일, 채소, 잡곡 섭취
장 ; BodyPart ;
노안 ; Condition ; 가까운 것이 잘 안 보이는 상태
시력 저하 ; Symptom ; 눈이 침침해지는 증상
근거리 흐림 ; Symptom ; 가까운 글씨가 잘 안 보임
돋보기 사용 ; Treatment ; 적절한 도수의 돋보기
안과 정기 검진 ; Treatment ; 정기 안과 검진
눈 ; BodyPart ;
식욕부진 ; Condition ; 먹고 싶은 욕구 저하
체중 감소 ; Symptom ; 의도치 않은 체중 감소
기력 저하 ; Symptom ; 기운이 없는 상태
소량 다회 식사 ; Treatment ; 조금씩 자주 먹기
영양 보충제 ; Treatment ; 경구 영양 보충
골다공증 ; Condition ; 뼈가 약해지는 상태
뼈 통증 ; Symptom ; 뼈 부위 통증
낙상 위험 ; RiskFactor ; 넘어지기 쉬운 상태
칼슘 섭취 ; Treatment ; 칼슘 + 비타민D 보충
낙상 예방 ; Treatment ; 환경 정리, 미끄럼 방지
뼈 ; BodyPart ;
""", sep=";")

# Seed relations as source ; target ; type.
EDGES = fields("""
불면증 ; 수면장애 ; SYMPTOM_OF
수면 패턴 변화 ; 수면장애 ; SYMPTOM_OF
주간 졸림 ; 수면장애 ; SYMPTOM_OF
수면장애 ; 규칙적 수면 습관 ; MANAGED_BY
수면장애 ; 수면 환경 개선 ; MANAGED_BY
수면장애 ; 낮 활동량 증가 ; MANAGED_BY
카페인 제한 ; 수면장애 ; PREVENTS
발톱 변형 ; 내향성 발톱 ; SYMPTOM_OF
발톱 통증 ; 내향성 발톱 ; SYMPTOM_OF
내향성 발톱 ; 발톱 관리 ; MANAGED_BY
내향성 발톱 ; 편한 신발 ; MANAGED_BY
내향성 발톱 ; 발 ; AFFECTS
발톱 변형 ; 발톱 무좀 ; SYMPTOM_OF
발톱 무좀 ; 발톱 관리 ; MANAGED_BY
고혈당 ; 당뇨 ; SYMPTOM_OF
저혈당 ; 당뇨 ; SYMPTOM_OF
갈증 ; 당뇨 ; SYMPTOM_OF
빈뇨 ; 당뇨 ; SYMPTOM_OF
당뇨 ; 혈당 모니터링 ; MANAGED_BY
당뇨 ; 식이 조절 ; MANAGED_BY
규칙적 운동 ; 당뇨 ; PREVENTS
안면홍조 ; 갱년기 ; SYMPTOM_OF
감정 기복 ; 갱년기 ; SYMPTOM_OF
갱년기 ; 호르몬 치료 ; MANAGED_BY
스트레스 관리 ; 갱년기 ; PREVENTS
잇몸 출혈 ; 치주 질환 ; SYMPTOM_OF
구취 ; 치주 질환 ; SYMPTOM_OF
치아 흔들림 ; 치주 질환 ; SYMPTOM_OF
치주 질환 ; 구강 위생 ; MANAGED_BY
치주 질환 ; 정기 치과 검진 ; MANAGED_BY
치주 질환 ; 구강 ; AFFECTS
소리 안 들림 ; 난청 ; SYMPTOM_OF
이명 ; 난청 ; SYMPTOM_OF
난청 ; 보청기 ; MANAGED_BY
난청 ; 청력 검사 ; MANAGED_BY
난청 ; 귀 ; AFFECTS
손발 저림 ; 말초신경병증 ; SYMPTOM_OF
감각 이상 ; 말초신경병증 ; SYMPTOM_OF
당뇨 ; 말초신경병증 ; CAUSES
말초신경병증 ; 혈액 순환 개선 ; MANAGED_BY
말초신경병증 ; 비타민B 보충 ; MANAGED_BY
소변 실수 ; 요실금 ; SYMPTOM_OF
빈뇨감 ; 요실금 ; SYMPTOM_OF
요실금 ; 골반저 운동 ; MANAGED_BY
요실금 ; 배뇨 훈련 ; MANAGED_BY
요실금 ; 방광 ; AFFECTS
머리카락 빠짐 ; 탈모 ; SYMPTOM_OF
탈모 ; 두피 관리 ; MANAGED_BY
탈모 ; 영양 섭취 ; MANAGED_BY
탈모 ; 두피 ; AFFECTS
스트레스 관리 ; 탈모 ; PREVENTS
만성기침 ; 폐질환 ; SYMPTOM_OF
호흡곤란 ; 폐질환 ; SYMPTOM_OF
가래 ; 폐질환 ; SYMPTOM_OF
폐질환 ; 호흡 운동 ; MANAGED_BY
금연 ; 폐질환 ; PREVENTS
폐질환 ; 폐 ; AFFECTS
피부 가려움 ; 노인성 피부 ; SYMPTOM_OF
피부 건조 ; 노인성 피부 ; SYMPTOM_OF
노인성 피부 ; 보습제 사용 ; MANAGED_BY
노인성 피부 ; 미지근한 물 세안 ; MANAGED_BY
노인성 피부 ; 피부 ; AFFECTS
피부 발적 ; 욕창 ; SYMPTOM_OF
욕창 ; 체위 변경 ; MANAGED_BY
욕창 ; 피부 보호 ; MANAGED_BY
욕창 ; 피부 ; AFFECTS
배변 곤란 ; 변비 ; SYMPTOM_OF
복부 팽만 ; 변비 ; SYMPTOM_OF
변비 ; 수분 섭취 ; MANAGED_BY
변비 ; 섬유질 섭취 ; MANAGED_BY
규칙적 운동 ; 변비 ; PREVENTS
변비 ; 장 ; AFFECTS
시력 저하 ; 노안 ; SYMPTOM_OF
근거리 흐림 ; 노안 ; SYMPTOM_OF
노안 ; 돋보기 사용 ; MANAGED_BY
노안 ; 안과 정기 검진 ; MANAGED_BY
노안 ; 눈 ; AFFECTS
체중 감소 ; 식욕부진 ; SYMPTOM_OF
기력 저하 ; 식욕부진 ; SYMPTOM_OF
식욕부진 ; 소량 다회 식사 ; MANAGED_BY
식욕부진 ; 영양 보충제 ; MANAGED_BY
뼈 통증 ; 골다공증 ; SYMPTOM_OF
골다공증 ; 낙상 위험 ; CAUSES
골다공증 ; 칼슘 섭취 ; MANAGED_BY
골다공증 ; 낙상 예방 ; MANAGED_BY
규칙적 운동 ; 골다공증 ; PREVENTS
골다공증 ; 뼈 ; AFFECTS
""", sep=";")

# Keyword limits and match thresholds of graph retrieval.
KEYWORDS_KEPT, CONTEXTS_KEPT, NAMES_PER_TYPE = 5, 3, 3
START_NODES, RELATED_LIMIT, MAX_DEPTH = 5, 20, 3
GAP_K, GAP_THRESHOLD, GAP_MIN = 2, 0.55, 0.04

# Wording of a formatted condition and of grouped neighbours.
FMT_HEAD, FMT_SYMPTOMS, FMT_TREATMENT = "▶ ", "  증상: ", "  관리: "
FMT_DASH, FMT_PREVENTION, FMT_RISK = " — ", "  예방: ", "  위험요인: "
FMT_RELATED = "' 관련 정보:"
TYPE_LABELS = fields("""
Condition ; 관련 질환
Symptom ; 관련 증상
Treatment ; 관리 방법
Lifestyle ; 생활 습관
RiskFactor ; 주의 사항
""", sep=";")
