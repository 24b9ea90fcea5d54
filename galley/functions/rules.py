"""Rule tables of proofreading as (pattern, type, severity, suggestion), group by group, in order."""

# Two forms of one particle side by side.
PARTICLE_PAIRS = (
    (r"(?<=[가-힣])(?:을를|를을)(?![가-힣])", "오탈자", "high", '을/를 중 하나만 사용 (받침 있으면 "을", 없으면 "를")'),
    (r"(?<=[가-힣])(?:이가|가이)(?![가-힣])", "오탈자", "high", '이/가 중 하나만 사용 (받침 있으면 "이", 없으면 "가")'),
    (r"(?<=[가-힣])(?:은는|는은)(?![가-힣])", "오탈자", "high", '은/는 중 하나만 사용 (받침 있으면 "은", 없으면 "는")'),
    (r"(?<=[가-힣])(?:와과|과와)(?![가-힣])", "오탈자", "high", '와/과 중 하나만 사용 (받침 있으면 "과", 없으면 "와")'),
    (r"에서서|에게서서", "오탈자", "high", '"서" 하나 삭제 → "에서" 또는 "에게서"'),
)

# Double passives.
DOUBLE_PASSIVES = tuple((p, "이중수동", "high", "단일 수동 또는 능동으로 변환") for p in (r" ?되어지", r"되어\s*지고", r"쓰여지", r"받아지", r"보여지", r"잊혀지", r"나뉘어지"))

# Redundant phrases.
REDUNDANT = (
    (r"할\s*수\s*가\s*있", "중복군더더기", "medium", '"할 수 있"으로 수정 (수가→수)'),
    (r"하게\s*되어\s*지", "중복군더더기", "medium", '"하게 되"로 수정'),
    (r"이미[ \t]+[가-힣]+[ \t]*한[ \t]*바[ \t]*있", "중복군더더기", "medium", '"이미 ~했다"로 줄이세요'),
    (r"라고\s*하는\s*것은", "중복군더더기", "medium", '"~은/는"으로 줄이세요'),
    (r"([가-힣])\s*인\s*것이다", "중복군더더기", "low", '"~이다"로 줄이세요'),
    (r"([가-힣])\s*는\s*것이다(?![가-힣])", "중복군더더기", "low", '"~다"로 줄이세요'),
    (r"매우\s*매우|아주\s*아주", "중복군더더기", "medium", "강조어 중복 삭제"),
    (r"각각의\s*각", "중복군더더기", "medium", '"각각의" 또는 "각"으로 통일'),
    (r"함께\s*같이|같이\s*함께", "중복군더더기", "medium", '"함께" 또는 "같이" 하나만 사용'),
    (r"있는[ \t]+중에[ \t]+있", "중복군더더기", "medium", '"고 있습니다"로 줄이세요 (이중 상태 표현)'),
    (r"중에[ \t]+있습니다", "중복군더더기", "medium", '"중입니다"로 줄이세요 (예: 진행 중입니다)'),
    (r"중에[ \t]+있다(?![가-힣])", "중복군더더기", "medium", '"중이다"로 줄이세요'),
)

# Two conjunctions of one meaning side by side.
CONJUNCTIONS = (
    (r"그러나[ \t]+하지만|하지만[ \t]+그러나", "접속사중복", "medium", '"그러나" 또는 "하지만" 하나만 사용'),
    (r"그리고[ \t]+또한|또한[ \t]+그리고", "접속사중복", "medium", '"그리고" 또는 "또한" 하나만 사용'),
    (r"따라서[ \t]+그러므로|그러므로[ \t]+따라서", "접속사중복", "medium", '"따라서" 또는 "그러므로" 하나만 사용'),
    (r"그래서[ \t]+따라서|따라서[ \t]+그래서", "접속사중복", "medium", '"그래서" 또는 "따라서" 하나만 사용'),
)

# Chinese characters in brackets, and punctuation.
HANJA = ((r"[가-힣]{2,}\([一-龥]{1,4}\)", "한자남용", "low", "한자 병기 불필요 — 한글만 표기하세요"),)
PUNCTUATION = (
    (r"[?!]{3,}", "문장부호오류", "medium", "?나 ! 하나만 사용"),
    (r"\.{4,}", "문장부호오류", "low", "줄임표는 …(말줄임표) 또는 ……으로"),
    (r",[ \t]*,", "문장부호오류", "high", "쉼표 중복 삭제"),
    (r"[가-힣][ \t]{2,}[가-힣]", "불필요한공백", "low", "불필요한 공백 삭제"),
)

# Misspelt loanwords.
LOANWORDS = tuple(
    (pattern, "외래어표기오류", severity, right)
    for pattern, severity, right in (
        ("컨텐츠", "medium", "콘텐츠"), ("메세지", "medium", "메시지"), ("리더쉽", "medium", "리더십"), ("파트너쉽", "medium", "파트너십"),
        ("멤버쉽", "medium", "멤버십"), ("워크플로우", "medium", "워크플로"), ("어플리케이션", "medium", "애플리케이션"),
        (r"어플(?=[^리]|$)", "medium", "앱 또는 애플리케이션"), ("데스크탑", "medium", "데스크톱"), ("프리젠테이션", "medium", "프레젠테이션"),
        ("네비게이션", "medium", "내비게이션"), ("악세서리", "medium", "액세서리"), ("다이나믹", "low", "다이내믹"), ("로보트", "medium", "로봇"),
        ("싸이트", "medium", "사이트"), ("시뮬레이팅", "medium", "시뮬레이션"), ("인터렉티브", "medium", "인터랙티브"), ("브라우져", "medium", "브라우저"),
        (r"서버(?=\s*사이드)", "low", "서버 사이드 (띄어쓰기 확인)"), (r"섀도우(?!박스)", "low", "섀도"), ("니즈", "low", '"요구" 또는 "필요" (한국어 표현 권장)'),
    )
)

# Translated style and stacked particles.
TRANSLATED = (
    (r"[가-힣]+에\s+있어서", "일본식표현", "medium", '"~에서"로 바꾸세요 (일본어 において 직역)'),
    (r"함에\s+있어서", "번역체", "medium", '"~할 때" 또는 "~하려면"으로 바꾸세요'),
    (r"[가-힣]+를?\s*통해서(?![가-힣])", "번역체", "low", '"통해"로 줄이세요 (통해서 → 통해)'),
    (r"(?:그것|이것)은\s+[가-힣]+이기도", "번역체", "medium", '영어식 주어 반복 — "또한 ~이다"로 통합하세요'),
    (r"[가-힣]{2,}적인\s+[가-힣]+에서", "일본식표현", "low", '"~에서" 또는 명사 직접 사용 권장 (기술적인 → 기술)'),
    (r"[가-힣]+에서의\s", "번역체", "medium", '"~에서의" → "~에서" ("시스템에서의 처리" → "시스템에서 처리")'),
    (r"[가-힣]+로서의\s", "번역체", "low", '"~로서의" → 생략하거나 "~로서 ~하는" ("편집자로서의 역할" → "편집자 역할" 또는 "편집자로서 하는 역할")'),
    (r"[가-힣]+로부터의\s", "번역체", "medium", '"~로부터의" → "~에서 온" 또는 "~의" ("사용자로부터의 피드백" → "사용자 피드백")'),
    (r"[가-힣]+에게서의\s", "번역체", "medium", '"~에게서의" → "~에게서 받은" 또는 "~의" ("친구에게서의 선물" → "친구가 준 선물")'),
    (r"[가-힣]+에\s*관해서의\s", "번역체", "medium", '"~에 관해서의" → "~에 관한" 또는 "~의" ("교육에 관해서의 논의" → "교육에 관한 논의")'),
    (r"[가-힣]+을\s*통해서의\s", "번역체", "medium", '"~을 통해서의" → "~을 통한" ("실험을 통해서의 검증" → "실험을 통한 검증")'),
    (r"[가-힣]+에\s*따라서의\s", "번역체", "medium", '"~에 따라서의" → "~에 따른" ("상황에 따라서의 판단" → "상황에 따른 판단")'),
)

# Statements without a source, and breaks between paragraphs.
UNSOURCED = (
    (r"(?:최근|일부|한)\s*연구에\s*따르면", "내용보완필요", "medium", "연구 출처(기관·논문명·연도) 명시 필요"),
    (r"\d+\s*%\s*(?:이상|향상|개선|감소|증가)", "내용보완필요", "medium", "수치 출처 및 측정 기준 명시 필요"),
    (r"보고도?\s*있습니다", "내용보완필요", "low", '"보고" 주체와 출처 명시 필요 (어느 기관·연도)'),
    (r"통계(?:가|도)\s*있습니다", "내용보완필요", "low", "통계 출처(기관·조사 시점) 명시 필요"),
    (r"알려져\s*있습니다", "내용보완필요", "low", '"알려져 있습니다" — 출처 없는 주장, 근거 명시 권장'),
)
TRANSITIONS = (
    (r"그런데\s+이와\s*동시에", "문단연결불량", "medium", '"한편"·"동시에" 중 하나로 정리하세요 (역접+동시 혼용 어색)'),
    (r"그것을\s*다루느냐", "문단연결불량", "low", '"그것" 지시 대상 불명확 — 앞 문단과의 연결이 단절됨'),
    (r"달려\s*있다고\s*할\s*수\s*있습니다", "문단연결불량", "low", '이 문장 이후 새 주제 전환 시 "한편"·"이와 달리" 등 전환어 삽입 권장'),
)

# clichés, as (pattern, severity, suggestion).
CLICHES = tuple(
    (pattern, "AI투", severity, right)
    for pattern, severity, right in (
        (r"현대\s*사회에서", "high", "AI 상투 도입부 — 삭제하고 본론부터 시작하세요"),
        (r"급속도로\s*발전하고\s*있는", "high", "AI 상투 — 구체적 수치나 사례로 교체하세요"),
        (r"[가-힣]+에\s*대해\s*알아보겠습니다", "high", "AI 상투 — 삭제하고 바로 내용을 시작하세요"),
        (r"[가-힣]+을\s*살펴보도록\s*하겠습니다", "high", 'AI 상투 — "~을 보겠습니다" 또는 삭제'),
        (r"매우\s*중요한\s*주제입니다", "medium", "AI 상투 — 왜 중요한지 구체적으로 쓰세요"),
        (r"뿐만\s*아니라", "low", '빈출 연결어 — 반복 시 "게다가", "더구나", "~도" 등으로 교체'),
        (r"더욱이(?![가-힣])", "low", '빈출 연결어 — 반복 시 "게다가", "한술 더 떠서" 등으로 교체'),
        (r"나아가(?![가-힣])", "low", "AI 빈출 — 문맥에 맞는 자연스러운 연결어로 교체"),
        (r"이는\s*[가-힣]+을\s*의미합니다", "high", "AI 상투 — 풀어서 직접 설명하세요"),
        (r"주목할\s*만한\s*점은", "medium", 'AI 상투 — "눈여겨볼 건", "재밌는 건" 등으로 교체'),
        (r"아무리\s*강조해도\s*지나치지\s*않", "high", "AI 상투 — 삭제하고 구체적 근거를 제시하세요"),
        (r"결론적으로(?![가-힣])", "high", 'AI 상투 마무리 — 삭제하거나 "정리하면", "한마디로" 등으로 교체'),
        (r"요약하자면(?![가-힣])", "medium", 'AI 상투 마무리 — "간추리면", "핵심만 뽑으면" 등으로 교체'),
        (r"종합하면(?![가-힣])", "medium", 'AI 상투 마무리 — 자연스럽게 끝내거나 "모아보면" 등으로 교체'),
        (r"신중한\s*접근이\s*필요합니다", "high", "AI 상투 — 구체적으로 어떤 접근이 필요한지 쓰세요"),
        (r"균형\s*잡힌\s*시각이\s*요구됩니다", "high", "AI 상투 — 어느 쪽 입장인지 명확히 하세요"),
        (r"지속적인\s*관심과\s*노력이\s*필요", "high", "AI 상투 — 삭제하거나 구체적 행동을 제시하세요"),
        (r"양날의\s*검", "high", "AI 진부 비유 — 신선한 비유로 교체하세요"),
        (r"동전의\s*양면", "high", "AI 진부 비유 — 신선한 비유로 교체하세요"),
        (r"빙산의\s*일각", "medium", "AI 진부 비유 — 구체적 수치로 규모를 보여주세요"),
        (r"[가-힣]+을\s*가지고\s*있다", "medium", 'have 직역 — "~이 있다"로 교체'),
        (r"[가-힣]+함으로써(?![가-힣])", "low", '번역투 — "~해서", "~하면" 등으로 바꾸세요'),
        (r"[가-힣]+중\s*하나이다", "medium", '"one of the" 직역 — "~도 있다", "대표적인 건" 등으로 교체'),
        (r"혁신적이고\s*창의적이?며?\s*효율적인", "high", "AI 수식 나열 — 형용사 하나만 남기세요"),
        (r"다양하고\s*여러\s*가지의", "high", "AI 의미 중복 수식 — 구체적 예시나 숫자로 교체"),
        (r"라고\s*할\s*수\s*있다", "medium", 'AI 단정 회피 — "~다"로 단정하세요. 자신감 있게'),
    )
)

_SPELLING, _SPACING = "맞춤법", "띄어쓰기"
# House spelling and spacing.
HOUSE = (
    (r"따라하기", _SPELLING, "high", "따라 하기 (본동사+본동사는 띄어 씀)"),
    (r"그리고는(?![가-힣])", _SPELLING, "medium", "그러고는 (그리고는 X)"),
    (r"그리고\s*나서", _SPELLING, "medium", "그러고 나서 (그리고 나서 X)"),
    (r"그럴려고", _SPELLING, "high", "그러려고 (그럴려고 X)"),
    (r"길다란", _SPELLING, "medium", "기다란 (길다란 X)"),
    (r"어플리케이션", "외래어표기오류", "medium", "애플리케이션"),
    (r"내려\s+받", _SPACING, "medium", "내려받다 (붙여쓰기)"),
    (r"하지\s*마라", _SPACING, "low", "하지 마라 (-지 말다는 띄어 씀)"),
    (r"해놓고(?=\s|[,.]|$)", _SPACING, "medium", '해 놓고 (보조용언 "놓다" 띄어 씀)'),
    (r"해보면(?=\s|[,.]|$)", _SPACING, "medium", '해 보면 (보조용언 "보다" 띄어 씀)'),
    (r"해주세요", _SPACING, "medium", '해 주세요 (보조용언 "주다" 띄어 씀)'),
    (r"해주는", _SPACING, "medium", '해 주는 (보조용언 "주다" 띄어 씀)'),
    (r"해줄", _SPACING, "medium", '해 줄 (보조용언 "주다" 띄어 씀)'),
    (r"해줘", _SPACING, "medium", '해 줘 (보조용언 "주다" 띄어 씀)'),
    (r"해버리", _SPACING, "medium", '해 버리 (보조용언 "버리다" 띄어 씀)'),
    (r"해내", _SPACING, "low", '해 내 (보조용언 "내다" 띄어 씀)'),
    (r"되어버리", _SPACING, "medium", '되어 버리 (보조용언 "버리다" 띄어 씀)'),
    (r"만들어놓", _SPACING, "medium", '만들어 놓 (보조용언 "놓다" 띄어 씀)'),
    (r"알아보", _SPACING, "low", '알아 보 (보조용언 "보다" 띄어 씀, 다만 "알아보다"는 합성어 인정)'),
    (r"할수(?:가|도|는|만)?\s*(?:있|없)", _SPACING, "high", '할 수 있/없 (의존명사 "수" 띄어 씀)'),
    (r"[가-힣](?:할|될|갈|볼|올|줄|쓸|살|알|풀)것(?:이[다라면]|인|을)", _SPACING, "high", '~할 것이다 (의존명사 "것" 띄어 씀)'),
    (r"[가-힣](?:할|된|한|인|일)때", _SPACING, "high", '~할 때 (의존명사 "때" 띄어 씀)'),
    (r"[가-힣](?:할|된|한|일)뿐", _SPACING, "high", '~할 뿐 (의존명사 "뿐" 띄어 씀)'),
    (r"[가-힣](?:할|한|된)듯", _SPACING, "medium", '~한 듯 (의존명사 "듯" 띄어 씀)'),
    (r"[가-힣](?:할|한|된)채", _SPACING, "medium", '~한 채 (의존명사 "채" 띄어 씀)'),
    (r"[가-힣](?:할|한|된)바", _SPACING, "medium", '~한 바 (의존명사 "바" 띄어 씀)'),
    (r"[가-힣](?:할|한|될)줄", _SPACING, "medium", '~할 줄 (의존명사 "줄" 띄어 씀)'),
    (r"[가-힣](?:하|되|인)는데", _SPACING, "low", '~하는 데 (의존명사 "데" 띄어 씀, 어미 "-는데"와 구별)'),
    (r"[가-힣](?:할|한)만큼", _SPACING, "medium", '~한 만큼 (의존명사 "만큼" 띄어 씀)'),
    (r"[가-힣](?:할|한|될)대로", _SPACING, "medium", '~할 대로 (의존명사 "대로" 띄어 씀)'),
    (r"[가-힣](?:할|한)리(?:가|는|도)\s*(?:없|있)", _SPACING, "medium", '~할 리가 없다 (의존명사 "리" 띄어 씀)'),
    (r"[가-힣](?:할|한)지(?:를|도|는)?\s", _SPACING, "low", '~할지 / ~할 지 (의문 의존명사 "지" 띄어 씀, 어미 "-ㄹ지"와 구별 주의)'),
    (r"\d+개월", _SPACING, "low", "숫자 + 개월 → 띄어 씀 (예: 3 개월)"),
    (r"\d+퍼센트", _SPACING, "low", "숫자 + 퍼센트 → 띄어 씀 (예: 50 퍼센트)"),
    (r"목표값", _SPACING, "medium", "목표 값 (띄어 씀)"),
    (r"결과값", _SPACING, "medium", "결과 값 (띄어 씀)"),
    (r"논리값", _SPACING, "medium", "논리 값 (띄어 씀)"),
    (r"기준값", _SPACING, "medium", "기준 값 (띄어 씀)"),
    (r"단위값", _SPACING, "medium", "단위 값 (띄어 씀)"),
    (r"텍스트값", _SPACING, "medium", "텍스트 값 (띄어 씀)"),
    (r"인덱스값", _SPACING, "medium", "인덱스 값 (띄어 씀)"),
    (r"셀값", _SPACING, "medium", "셀 값 (띄어 씀)"),
    (r"같이\s하", _SPACING, "low", '같이하 (부사+하다 붙여 씀, 다만 "함께 하다"는 띄어 쓸 수 있음)'),
    (r"촛점", _SPELLING, "high", "초점 (한자어+한자어 사이시옷 없음)"),
    (r"됬", _SPELLING, "high", '됐 ("되었다"의 준말은 "됐다")'),
    (r"몇\s*일", _SPELLING, "high", '며칠 ("몇 일"은 비표준)'),
    (r"덮히다", _SPELLING, "high", "덮이다"),
    (r"갈려고", _SPELLING, "high", '가려고 ("-려고"가 맞음, ㄹ 덧붙이지 않음)'),
    (r"버틸려고", _SPELLING, "high", "버티려고"),
    (r"치루다", _SPELLING, "medium", "치르다"),
    (r"흉칙", _SPELLING, "medium", "흉측"),
    (r"몰아부치", _SPELLING, "medium", "몰아붙이다"),
    (r"희안", _SPELLING, "medium", "희한"),
    (r"바램", _SPELLING, "high", '바람 ("바라다"의 명사형)'),
    (r"만듬", _SPELLING, "high", "만듦 (ㄹ받침 명사형은 -ㄻ)"),
    (r"있슴", _SPELLING, "high", '있음 (명사형 어미 "-음")'),
    (r"없슴", _SPELLING, "high", "없음"),
    (r"어떻게\s*됬", _SPELLING, "high", '어떻게 됐 ("되었"의 준말은 "됐")'),
    (r"안됀다", _SPELLING, "high", '안 된다 ("되"+"ㄴ다"="된다")'),
    (r"안되요", _SPELLING, "high", '안 돼요 ("되어요"의 준말은 "돼요")'),
    (r"할께", _SPELLING, "high", '할게 ("-ㄹ게"가 맞음)'),
    (r"할꺼", _SPELLING, "high", '할 거 ("-ㄹ 것"의 구어형)'),
    (r"머리속", _SPELLING, "medium", "머릿속 (사이시옷 필요)"),
    (r"위부분", _SPELLING, "medium", "윗부분 (사이시옷 필요)"),
    (r"아래부분", _SPELLING, "medium", "아랫부분 (사이시옷 필요)"),
    (r"햇갈리", _SPELLING, "high", "헷갈리 (햇 X → 헷)"),
    (r"헛갈리", _SPELLING, "high", "헷갈리 (헛 X → 헷)"),
    (r"금새", _SPELLING, "high", '금세 ("금시에"의 준말)'),
    (r"일일히", _SPELLING, "high", '일일이 ("-이"가 맞음)'),
    (r"깨끗히", _SPELLING, "high", '깨끗이 ("-이"가 맞음)'),
    (r"어의없", _SPELLING, "high", "어이없 (어의 X → 어이)"),
    (r"설레임", _SPELLING, "medium", '설렘 ("설레다"의 명사형)'),
    (r"오랫만", _SPELLING, "high", "오랜만 (오랫 X → 오랜)"),
    (r"오랜동안", _SPELLING, "medium", "오랫동안 (오랜 X → 오랫)"),
    (r"웬지", _SPELLING, "high", '왠지 ("왜인지"의 줄임, "웬" X)'),
    (r"됄", _SPELLING, "high", '될 ("되"+"ㄹ"="될")'),
    (r"되요(?=\s|[,.]|$)", _SPELLING, "high", '돼요 ("되어요"의 준말)'),
    (r"되서(?=\s|[,.]|$)", _SPELLING, "high", '돼서 ("되어서"의 준말)'),
    (r"되가(?=\s|[,.]|$)", _SPELLING, "high", '돼가 ("되어가"의 준말)'),
    (r"안되(?=\s|[,.]|$)", _SPELLING, "medium", '안 돼 ("안 되어"의 준말, 띄어쓰기+돼)'),
    (r"울려퍼지", _SPELLING, "medium", "울려 퍼지 (울리다+퍼지다, 띄어 씀)"),
    (r"갈려면", _SPELLING, "high", '가려면 ("-려면"이 맞음)'),
    (r"으므로써", _SPELLING, "high", '"으므로"(이유) + "써" 불필요. "으므로" 또는 "으로써"(수단) 중 택1'),
    (r"로서의", _SPELLING, "low", '"로서"(자격) vs "로써"(수단) 구분 확인'),
    (r"몇일", _SPELLING, "high", '며칠 ("몇+일"의 본래 형태는 "며칠")'),
    (r"회수(?=를|가|는|의|에)", _SPELLING, "low", '"회수"(되찾음) vs "횟수"(번의 수) 확인'),
    (r"갯수", _SPELLING, "high", "개수 (한자어+한자어에 사이시옷 없음)"),
    (r"파랗네", _SPELLING, "high", "파라네 (ㅎ불규칙: 파랗+네→파라네)"),
    (r"빨갛네", _SPELLING, "high", "빨가네 (ㅎ불규칙: 빨갛+네→빨가네)"),
    (r"하얗네", _SPELLING, "high", "하야네 (ㅎ불규칙: 하얗+네→하야네)"),
    (r"왠만하", _SPELLING, "high", '웬만하 ("왠"은 "왜인지"의 줄임에만 사용)'),
    (r"왠만큼", _SPELLING, "high", "웬만큼"),
    (r"낳다(?=\s|[,.]|$)", _SPELLING, "low", '"낳다"(출산) vs "낫다"(우월/회복) vs "났다"(나다의 과거) 확인'),
    (r"나을수", _SPELLING, "medium", '나을 수 ("낫다"의 활용+의존명사 띄어 씀)'),
    (r"어떻해", _SPELLING, "high", '어떡해 ("어떻게 해"의 준말은 "어떡해")'),
    (r"어떻게해", _SPELLING, "medium", '어떡해 또는 "어떻게 해" (띄어 씀)'),
    (r"그러므로써", _SPELLING, "high", '"그러므로"(이유)와 "그럼으로써"(수단) 구별'),
    (r"솔직희", _SPELLING, "high", '솔직히 ("솔직하다"→"솔직히")'),
    (r"정확희", _SPELLING, "high", '정확히 ("정확하다"→"정확히")'),
    (r"어의가\s*없", _SPELLING, "high", '어이가 없 ("어이"가 맞음, "어의"는 의사를 뜻하는 한자어)'),
    (r"세삼스러", _SPELLING, "high", '새삼스러 ("세삼" X → "새삼")'),
    (r"덧붙히", _SPELLING, "high", '덧붙이 ("덧붙이다"가 맞음)'),
    (r"어거지", _SPELLING, "high", '억지 ("어거지" X → "억지")'),
    (r"우겨넣", _SPELLING, "medium", '욱여넣 ("욱여넣다"가 맞음)'),
    (r"담궈", _SPELLING, "high", '담가 ("담그다"의 활용은 "담가")'),
    (r"담궈놓", _SPELLING, "high", '담가 놓 ("담그다"→"담가"+"놓다")'),
    (r"곰곰히", _SPELLING, "high", '곰곰이 ("-이"가 맞음)'),
    (r"일부로(?=\s|[,.]|$)", _SPELLING, "medium", '"일부로"(일부분으로) vs "일부러"(고의로) 확인'),
    (r"문제\s없", _SPACING, "medium", "문제없 (합성어 붙여 씀)"),
    (r"상관\s없", _SPACING, "medium", "상관없 (합성어 붙여 씀)"),
    (r"궁금해\s하", _SPACING, "medium", '궁금해하 ("-어하다" 형용사 뒤 붙여 씀)'),
    (r"걱정\s되", _SPACING, "low", "걱정되 (합성어 붙여 씀)"),
    (r"짜증\s나", _SPACING, "low", "짜증나 (합성어 붙여 씀)"),
)

#: All groups but those of clichés and house spelling, which not every house asks for.
SURFACE = PARTICLE_PAIRS + DOUBLE_PASSIVES + REDUNDANT + CONJUNCTIONS + HANJA + PUNCTUATION + LOANWORDS + TRANSLATED + UNSOURCED + TRANSITIONS

#: All groups, in order.
EVERY = PARTICLE_PAIRS + DOUBLE_PASSIVES + REDUNDANT + CONJUNCTIONS + HANJA + PUNCTUATION + LOANWORDS + TRANSLATED + CLICHES + HOUSE + UNSOURCED + TRANSITIONS
