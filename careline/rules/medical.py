"""Medical vocabulary of the default (Korean) rule pack."""

from careline.rules.text import described, fields, words

# Medical nouns by category, with a description where it differs.
NOUNS = described("""
symptom: 통증, 두통, 복통, 관절통, 신경통, 요통, 기침, 콧물, 가래, 구토, 구역질, 설사, 변비, 부종, 발열, 열=발열, 경련, 발작, 출혈, 멍=타박상, 재채기, 현기증, 이명, 마비, 욕창, 탈수, 감기, 몸살, 졸음, 피로, 피곤=피로
condition: 당뇨=당뇨병, 고혈압, 저혈압, 관절염, 골다공증, 백내장, 녹내장, 치매, 건망증, 불면증, 불면=불면증, 난청, 요실금, 변실금, 폐렴, 천식, 암, 우울증, 골절, 낙상, 탈모, 갱년기, 노안, 비만, 수면무호흡=수면무호흡증, 콜레스테롤=고콜레스테롤혈증
body_part: 무릎, 허리, 어깨, 목, 머리, 손목, 발목, 관절, 뼈, 근육, 발톱, 손톱, 피부, 잇몸, 치아, 눈, 귀, 폐, 심장, 간, 신장, 위, 장, 다리, 팔, 가슴, 배
medication: 약, 수면제, 진통제, 항생제, 연고, 주사, 알약, 물약, 처방전
treatment: 수술, 진료, 검사, 진단, 치료, 처방, 입원, 퇴원, 재활
vital_sign: 혈압, 혈당, 맥박, 체온, 체중
sleep: 잠=수면, 수면, 낮잠, 악몽
nutrition: 식욕, 입맛=식욕, 식사, 밥=식사, 영양, 비타민, 소화
emotion: 우울, 불안, 걱정, 스트레스, 눈물
cognitive: 기억, 집중, 인지, 판단
hygiene: 목욕, 샤워, 세수, 양치, 기저귀, 화장실, 소변, 대변
activity: 산책, 운동, 걷기, 체조, 스트레칭
emergency: 응급, 구급, 의식, 호흡
treatment: 병원, 의원, 한의원, 응급실, 약국
""")

# Medical verb and adjective stems; the description is the lemma.
VERBS = described("""
symptom: 아프=통증, 쑤시=쑤심, 결리=결림, 저리=저림, 가렵=가려움, 붓=부종, 어지럽=어지러움, 어지러=어지러움, 메스껍=메스꺼움, 토하=구토, 기침하=기침, 떨리=떨림, 욱신거리=욱신거림, 화끈거리=화끈거림
condition: 넘어지=낙상, 미끄러지=낙상, 쓰러지=낙상, 떨어지=낙상, 빠지=낙상, 부러지=골절, 비틀거리=균형 장애, 다치=부상
sleep: 잠들=수면 장애
cognitive: 잊어버리=기억력 저하, 깜빡하=기억력 저하, 헷갈리=인지 혼란
emotion: 슬프=슬픔, 외롭=외로움, 무섭=두려움, 두렵=두려움, 짜증나=짜증, 화나=분노
nutrition: 삼키=연하
medication: 복용하=복용
""")

# Compound symptom patterns as pattern ; category ; description.
COMPOUNDS = fields("""
잠.{0,4}못.{0,4}(자|들|잤) ; sleep ; 수면 장애
잠.{0,2}(안|못)\\s*(오|와|들) ; sleep ; 수면 장애
밤.{0,4}(깨|뒤척|잠) ; sleep ; 수면 장애
새벽.{0,4}(깨|눈) ; sleep ; 수면 장애
숨.{0,4}(못|안|차|찬|쉬) ; emergency ; 호흡 곤란
숨.{0,2}(가쁘|막히) ; emergency ; 호흡 곤란
밥.{0,4}(못|안|잘).{0,4}(먹|넘) ; nutrition ; 식사 곤란
입맛.{0,4}(없|안) ; nutrition ; 식욕 부진
소화.{0,4}(안|못|잘) ; nutrition ; 소화 불량
변.{0,4}(안|못).{0,4}(나|보) ; symptom ; 배변 곤란
소변.{0,4}(못\\s*참|자주|실수) ; condition ; 요실금
(눈|시력).{0,4}(침침|흐릿|안\\s*보) ; condition ; 시력 저하
귀.{0,4}(안\\s*들|잘\\s*안) ; condition ; 청력 저하
(손|발).{0,4}(저리|감각|떨리) ; symptom ; 말초 신경 증상
(머리|가슴|배).{0,4}(아프|아파|통증) ; symptom ; 통증
약.{0,4}(너무\\s*많|과다|과량) ; emergency ; 약물 과다
약.{0,4}(먹|복용|드시).{0,4}(안|않|못) ; medication ; 복약 누락
부작용.{0,4}(있|나타|생기|심하) ; medication ; 약물 부작용
발톱.{0,6}(안|안쪽|파고|들어) ; condition ; 내향성 발톱
발톱.{0,6}(두꺼|변형|휘) ; condition ; 발톱 변형
피부.{0,6}(가려|건조|트러블) ; symptom ; 피부 증상
머리카락.{0,4}(빠지|빠져|탈모) ; condition ; 탈모
기운.{0,4}(없|빠지|저하) ; symptom ; 기력 저하
(기침|콧물).{0,4}(오래|안\\s*멈|계속) ; symptom ; 지속 증상
혈당.{0,4}(높|올라|떨어|낮) ; vital_sign ; 혈당 이상
혈압.{0,4}(높|올라|떨어|낮) ; vital_sign ; 혈압 이상
(길|방향).{0,4}(잃|모르|헤매) ; cognitive ; 방향 감각 상실
(사람|이름).{0,4}(기억|모르|잊) ; cognitive ; 인지 기능 저하
""", sep=";")

# Morphemes ignored by the verb lookup, and verbs kept all the same.
MORPH_STOP_WORDS = words("""
이, 가, 을, 를, 에, 의, 도, 만, 은, 는, 에서, 으로, 와, 과, 로, 서, 고, 게, 요
좀, 잘, 많이, 너무, 정말, 진짜, 그냥, 되게, 아주, 매우, 약간, 조금
저, 나, 제, 내, 우리, 거, 것, 데
하, 되, 있, 없, 이, 보, 알, 가, 오, 주, 받, 내, 나오
""")
MORPH_STOP_EXEMPT = words("자, 삼키, 토하")

# Tags the noun and the verb lookups accept.
NOUN_TAG_PREFIX = "NN"
VERB_TAGS = words("VV, VA, XSV, XSA")

# Keywords of the health span matcher.
HEALTH_KEYWORDS = words("""
병원, 의원, 클리닉, 진료, 진찰, 치료, 수술, 입원, 퇴원, 의사, 간호사, 약사, 한의원, 응급실, 외래, 내과, 정형외과
잠, 수면, 불면, 불면증, 숙면, 낮잠, 밤잠, 새벽, 기상, 잠들다, 깨다, 뒤척이다, 수면제
소변, 대변, 배변, 화장실, 변비, 설사, 요실금, 빈뇨
낙상, 넘어지다, 미끄러지다, 쓰러지다, 다치다, 멍, 골절, 어지럽다, 어지러움, 현기증, 균형
통증, 아프다, 쑤시다, 결리다, 저리다, 두통, 복통, 관절통, 허리, 무릎, 어깨, 목, 손목, 발목
식사, 밥, 음식, 식욕, 입맛, 먹다, 영양, 체중, 살, 비만, 저체중, 당뇨, 혈당
약, 복용, 처방, 부작용, 알약, 물약, 연고, 주사
우울, 불안, 걱정, 스트레스, 외롭다, 슬프다, 화나다, 무기력, 의욕, 기분, 감정
기억, 건망증, 치매, 인지, 집중, 혼란, 헷갈리다, 잊어버리다, 깜빡하다
산책, 운동, 걷기, 체조, 스트레칭, 목욕, 샤워, 세수, 양치, 옷, 착용, 외출
열, 기침, 콧물, 가래, 호흡, 숨, 심장, 혈압, 맥박, 체온, 부종, 붓다
""")
# Entity labels that count as health related by themselves.
HEALTH_LABELS = words("QUANTITY, TIME, DATE")

# Words dropped from the word context around a term.
CONTEXT_STOP_WORDS = words("""
은, 는, 이, 가, 을, 를, 에, 의, 도, 만
그, 저, 이것, 그것, 저것, 여기, 거기, 저기
것, 수, 등, 및, 또, 또는, 그리고, 하지만
으로, 에서, 로, 와, 과, 요, 네, 예, 아니요
""")

# Token classes of the context tokenizer.
TOKEN_PATTERN = "[가-힣]+(?:[은는이가을를에서로와과의도만])?|[a-zA-Z]+|\\d+(?:\\.\\d+)?|[^\\s\\w]"

# Colloquial wording -> medical term.
COLLOQUIAL = fields("""
잠을?\\s*못 ; 불면증
잠이?\\s*안 ; 불면증
밤에?\\s*깨 ; 수면 패턴 변화
발톱.*(안|안쪽|파고|들어) ; 내향성 발톱
발톱.*(두꺼|변형|휘) ; 발톱 변형
소변.*(못 참|실수|자주) ; 요실금
머리.*(빠지|빠져|탈모) ; 머리카락 빠짐
피부.*(가려|건조|트러블) ; 피부 가려움
숨.*(차|안 쉬|못 쉬) ; 호흡곤란
기침.*(오래|안 멈|계속) ; 만성기침
손.*(저리|감각) ; 손발 저림
발.*(저리|감각) ; 손발 저림
귀.*(안 들|잘 안) ; 소리 안 들림
눈.*(침침|흐릿|안 보) ; 시력 저하
잇몸.*(피|출혈|붓) ; 잇몸 출혈
변.*(안 나|못 보|힘들) ; 배변 곤란
배.*(더부룩|팽만|부른) ; 복부 팽만
기운.*(없|빠지|저하) ; 기력 저하
뼈.*(아프|통증|쑤시) ; 뼈 통증
혈당.*(높|올라) ; 고혈당
혈당.*(낮|떨어) ; 저혈당
""", sep=";")

# Topic nouns and symptom verbs (alternation order matters).
TOPIC_NOUNS = words("""
발톱, 손톱, 피부, 머리, 눈, 귀, 코, 입, 목, 허리, 무릎, 어깨, 손, 발
가슴, 배, 등, 팔, 다리, 관절, 근육, 뼈, 잇몸, 치아
혈압, 혈당, 당뇨, 수면, 잠, 약, 통증, 두통, 기침
구강, 탈모, 갱년기, 요실금, 욕창, 변비, 설사, 소화
폐, 심장, 간, 신장, 위, 장, 대장, 소장, 방광
난청, 노안, 골다공증, 구축, 식욕
""")
TOPIC_VERBS = words("""
아프, 아파, 저리, 가려, 붓, 쑤시, 안 나, 안나, 못 자, 못자
안 들, 안들, 들어가, 빠지, 떨리, 어지러, 메스꺼
""")

# Health words that open the full analysis and mark a health topic.
# (Blood pressure and blood sugar are spelled correctly here; see README.)
GATE_WORDS = words("""
아프, 아파, 통증, 증상, 병원, 약, 수술, 검사
진료, 치료, 질환, 질병, 피부, 혈압, 혈당
당뇨, 수면, 잠, 기침, 두통, 어지러, 무릎, 허리
관절, 변비, 설사, 요실금, 탈모, 갱년기
난청, 골다공증, 호흡, 심장, 발톱, 손톱, 눈, 귀
소화불량, 소화가 안
""")

# Words without content for the repeated-question test.
STEM_STOP_WORDS = words("""
그래서, 그러면, 그런데, 하지만, 그리고, 때문에
여기서, 거기서, 이것은, 그것은, 저것은, 어떻게
알겠어, 네네네, 그래요, 그래도, 그러니, 그러나
이제, 지금, 나갈, 나가, 가려, 하려, 하고
먹었, 먹어, 했어, 했다, 할거, 좋은, 좋아, 잘되
너무, 정말, 조금, 그냥, 많이
오늘, 내일, 어제, 아까, 요즘, 나중
얘기, 이야기, 재밌, 재미, 심심, 하나
뭐가, 뭐라, 뭐든, 무슨, 어떤, 왜냐
해줘, 해주, 알려, 들려, 하자, 할까
같이, 혼자, 우리, 나는, 저는, 거기, 여기
""")
# Word pattern and endings removed once from the end of a word.
STEM_WORD_PATTERN = "[가-힣]{2,}"
STEM_SUFFIXES = words("""
이요, 에요, 아요, 어요, 해요, 하고, 인데, 은데, 는데, 아서, 어서, 해서
이가, 에서, 으로, 에게, 까지, 부터, 조차, 마저, 이나, 이랑, 하면, 으면
니다, 습니, 세요, 시다, 네요, 지요, 거든, 는지, 런지, ㄴ데, ㄹ까, 아도, 어도
이, 을, 를, 은, 는, 에, 의, 과, 와, 도, 만, 로, 가, 요, 서, 고, 게, 며, 지, 니, 다, 자, 면, 죠, 네, 데, 래, 든
""")

# Clinical terms that redaction should leave in place.
CLINICAL_TERMS = words("""
혈압, 혈당, 통증, 수면, 불면, 어지럼, 관절, 골다공증, 당뇨, 심장, 호흡, 기침, 두통, 복통
부종, 낙상, 균형, 기억력, 인지, 식욕, 체중, 운동, 산책, 복약, 약물, 수술, 검진, 진료
""")

# Symptom flags as flag ; keywords, and words that raise the alert.
SYMPTOM_FLAGS = [
    (flag, words(kws))
    for flag, kws in fields("""
두통 ; 머리, 아프, 두통, 지끈
어지러움 ; 어지러, 빙빙, 균형
기억력 ; 기억, 잊어, 생각안나, 까먹
수면 ; 잠, 못자, 불면, 깨
식욕 ; 밥, 못먹, 입맛, 식욕
통증 ; 아프, 쑤시, 통증, 뻐근
호흡 ; 숨, 답답, 가슴
배변 ; 변비, 설사, 화장실
""", sep=";")
]
ALERT_WORDS = words("쓰러, 넘어, 피, 의식, 숨, 응급, 119, 병원")
ALERT_ADVICE = "⚠️ 보호자 또는 의료진에게 즉시 연락이 필요합니다."
SYMPTOM_ADVICE = fields("""
두통 ; 충분히 쉬시고, 물을 드세요. 두통이 계속되면 보호자에게 알려주세요.
어지러움 ; 천천히 움직이시고, 앉아서 쉬세요. 혼자 걷지 마세요.
기억력 ; 걱정하지 마세요. 중요한 것은 메모해 두시면 좋아요.
수면 ; 규칙적인 수면 시간을 유지하고, 자기 전 따뜻한 우유가 도움이 됩니다.
""", sep=";")

# Text kept as is by the script filter (a Hangul syllable).
HANGUL_CLASS = "[가-힣]"

