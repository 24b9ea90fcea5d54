"""Fixed values of the domain: word lists and weights that results depend on, and nothing else."""

# Topics of a book title and the words that show them.
TOPICS: dict[str, tuple[str, ...]] = {
    "AI/LLM 일반": ("ai", "인공지능", "llm", "gpt", "클로드", "제미나이", "생성형", "챗gpt", "오픈ai", "openai", "claude", "gemini"),
    "바이브코딩/노코드": ("바이브 코딩", "바이브코딩", "vibe coding", "노코드", "로우코드"),
    "AI 에이전트/RAG": ("에이전트", "agent", "rag", "랭체인", "langchain", "langgraph", "mcp", "에이전틱"),
    "프롬프트/활용": ("프롬프트", "prompt", "ai 활용", "업무 자동화", "활용법", "활용 가이드"),
    "이미지/영상 AI": ("이미지 생성", "stable diffusion", "미드저니", "comfyui", "영상 ai", "sora", "캡컷", "영상 편집", "ai 영상", "ai 쇼츠"),
    "데이터분석/사이언스": ("데이터 분석", "데이터분석", "판다스", "pandas", "데이터 사이언스", "통계", "r 프로그래밍"),
    "딥러닝/머신러닝": ("딥러닝", "머신러닝", "deep learning", "machine learning", "텐서플로", "파이토치", "트랜스포머"),
    "파이썬": ("파이썬", "python", "점프 투 파이썬"),
    "웹개발": ("웹", "리액트", "react", "next.js", "스프링", "spring", "html", "css", "자바스크립트", "타입스크립트"),
    "앱개발/모바일": ("앱 개발", "flutter", "swift", "코틀린", "안드로이드", "ios"),
    "컴퓨터과학/기초": ("컴퓨터 개론", "자료구조", "알고리즘", "운영체제", "컴퓨팅", "이산수학", "c언어", "c++", "자바 프로그래밍"),
    "클라우드/DevOps": ("클라우드", "aws", "azure", "도커", "쿠버네티스", "kubernetes", "devops", "terraform"),
    "보안/해킹": ("보안", "해킹", "정보보안", "사이버", "모의침투"),
    "엑셀/오피스": ("엑셀", "excel", "파워포인트", "한글", "오피스", "워드"),
    "게임개발": ("게임 개발", "유니티", "unity", "언리얼", "unreal", "게임 프로그래밍"),
    "비전공자/교양": ("비전공자", "교양", "코딩 입문", "처음 배우는", "쉽게 배우는", "혼자 공부"),
    "자격증/취업": ("자격증", "정보처리", "취업", "코딩 테스트", "코딩테스트"),
    "로봇/IoT/하드웨어": ("로봇", "아두이노", "라즈베리", "iot", "반도체", "하드웨어", "임베디드"),
    "블록체인/Web3": ("블록체인", "web3", "nft", "솔리디티", "이더리움"),
}
NO_TOPIC = "기타"

# Parts of news texts and the keyword that each stands for.
KEYWORDS: dict[str, str] = {
    "agent": "AI Agent", "agentic": "AI Agent", "mcp": "MCP", "rag": "RAG", "llm": "LLM", "language model": "LLM",
    "fine-tun": "Fine-tuning", "fine tun": "Fine-tuning", "multimodal": "Multimodal", "vision": "Vision",
    "code": "Coding", "coding": "Coding", "developer": "Developer Tools", "sdk": "SDK/API", "api": "SDK/API",
    "framework": "Framework", "open source": "Open Source", "open-source": "Open Source", "benchmark": "Benchmark",
    "safety": "AI Safety", "alignment": "AI Safety", "reasoning": "Reasoning", "chain-of-thought": "Reasoning",
    "embedding": "Embeddings", "vector": "Vector DB", "diffusion": "Image AI", "image generat": "Image AI",
    "video": "Video AI", "speech": "Speech/Audio", "voice": "Speech/Audio", "robot": "Robotics", "embodied": "Robotics",
    "quantiz": "Optimization", "inference": "Optimization", "deploy": "Deployment", "kubernetes": "Cloud/DevOps",
    "docker": "Cloud/DevOps", "cloud": "Cloud/DevOps", "security": "Security", "privacy": "Security",
    "education": "AI Education", "tutorial": "AI Education", "enterprise": "Enterprise AI", "workflow": "Automation",
    "automat": "Automation", "claude": "Claude", "gpt": "GPT", "gemini": "Gemini", "cursor": "AI Coding",
    "copilot": "AI Coding", "vibe cod": "Vibe Coding",
    "에이전트": "AI Agent", "에이전틱": "AI Agent", "바이브 코딩": "Vibe Coding", "바이브코딩": "Vibe Coding",
    "클로드": "Claude", "제미나이": "Gemini", "파인튜닝": "Fine-tuning", "미세조정": "Fine-tuning", "프롬프트": "Prompt",
    "자동화": "Automation", "오픈소스": "Open Source", "데이터 분석": "Data Analysis", "데이터분석": "Data Analysis",
    "머신러닝": "ML/DL", "딥러닝": "ML/DL", "생성형": "Generative AI", "생성ai": "Generative AI", "생성 ai": "Generative AI",
    "랭체인": "LangChain", "langchain": "LangChain", "langgraph": "LangChain", "벡터": "Vector DB", "임베딩": "Embeddings",
    "쿠버네티스": "Cloud/DevOps", "도커": "Cloud/DevOps", "보안": "Security", "해킹": "Security", "n8n": "Automation",
    "make": "Automation", "챗봇": "Chatbot", "chatbot": "Chatbot", "sora": "Video AI", "영상 ai": "Video AI", "이미지 생성": "Image AI",
}

# Weight of a news source by its type; other types weigh DEFAULT_WEIGHT.
TYPE_WEIGHTS: dict[str, float] = {"vendor": 0.5, "media": 1.0, "corp": 1.5, "community": 2.0}
DEFAULT_TYPE, DEFAULT_WEIGHT = "media", 1.0

# Role marks that end a part of an author field; the first stands for the second.
ROLES = ("공저", "저", "역", "감수", "그림", "편", "원작", "사진", "엮음", "해설")
AUTHOR = "저"

# Phrases of news titles that hint at a book (strong alone, weak beside a context).
STRONG_SIGNALS = ("new model", "open source", "framework", "sdk", "llm", "fine-tun", " rag ", "mcp", "출시", "오픈소스", "프레임워크")
WEAK_SIGNALS = ("launch", "release", "announce", "introduce", "agent", "coding", "benchmark")
SIGNAL_CONTEXTS = ("ai", "ml", "dev", "cloud", "data", "python", "javascript", "rust", "kubernetes", "docker", "api")

# Upper bounds of the price histogram and its labels; the last has no bound.
PRICE_BINS = ((15000, "0~15천원"), (20000, "15~20천원"), (25000, "20~25천원"), (30000, "25~30천원"), (35000, "30~35천원"), (40000, "35~40천원"), (50000, "40~50천원"))
PRICE_TOP = "50천원 이상"

# Words of titles on vibe coding, and the tools that such a title belongs to if it names one, in order.
VIBE_WORDS = ("바이브 코딩", "바이브코딩", "vibe cod")
VIBE_TOOLS = (
    (("n8n",), "노코드/자동화"),
    (("mcp",), "MCP/AI에이전트"),
    (("나노바나나", "나노 바나나"), "AI 영상/이미지생성"),
    (("cursor ai", "커서 ai"), "커서/코덱스/코파일럿/안티그래비티"),
    (("코덱스", "codex cli", "codex"), "커서/코덱스/코파일럿/안티그래비티"),
    (("코파일럿", "copilot"), "커서/코덱스/코파일럿/안티그래비티"),
    (("안티그래비티", "antigravity"), "커서/코덱스/코파일럿/안티그래비티"),
    (("클로드 코드", "claude code"), "클로드/Claude"),
    (("cursor", "커서"), "커서/코덱스/코파일럿/안티그래비티"),
)

# Words that name an AI tool, and the subjects that come before the tool in a title with both, in order.
AI_TOOL_WORDS = ("챗gpt", "chatgpt", "제미나이", "gemini", "클로드", "claude", "코파일럿", "copilot", "ai로", "with ai")
SUBJECTS_BEFORE_TOOLS = (
    (("sql", "데이터베이스", "oracle", "mysql", "postgresql"), "데이터베이스/SQL"),
    (("파이썬", "python"), "파이썬"),
    (("자바스크립트", "javascript", "리액트", "react", "타입스크립트", "typescript"), "자바스크립트/웹프론트"),
    (("자바 ", "java ", "스프링", "spring"), "스프링/백엔드"),
    (("엑셀", "excel"), "엑셀"),
    (("포토샵", "photoshop", "일러스트레이터", "illustrator"), "포토샵/일러스트레이터"),
    (("피그마", "figma"), "피그마/UX·UI"),
    (("스프레드 시트 with 노션", "with 노션 에이전트"), "노션"),
)

# Shelves of lecture platforms and the category of books that each stands for.
LECTURE_SHELVES = {
    "AI 생산성": "AI 통합 활용서", "AI TECH": "AI 활용/비즈니스", "AI/업무생산성": "AI 통합 활용서", "RAG & AI Agent": "MCP/AI에이전트",
    "LLM": "LLM/프롬프트엔지니어링", "딥러닝/머신러닝": "머신러닝/딥러닝", "2D/3D 이미지 생성": "AI 영상/이미지생성", "영상 생성": "AI 영상/이미지생성",
    "백엔드 개발": "스프링/백엔드", "프론트엔드 개발": "자바스크립트/웹프론트", "모바일 앱 개발": "모바일/앱개발", "데이터분석": "데이터분석",
    "데이터 엔지니어링": "데이터분석", "DevOps/Infra": "클라우드/인프라", "반도체": "컴퓨터구조/하드웨어", "자율주행/로봇": "컴퓨터구조/하드웨어",
    "마케팅": "블로그/SNS마케팅", "엑셀/피피티/보고서": "엑셀", "UX/UI": "피그마/UX·UI", "게임 개발": "게임개발", "보안": "보안/정보보호",
    "네트워크": "네트워크", "파이썬": "파이썬", "자바": "자바", "알고리즘/자료구조": "알고리즘/자료구조/코딩테스트",
    "컴퓨터 공학/SW 엔지니어링": "컴퓨터개론/SW공학", "개발/데이터": "개발실무/CS교양", "컴퓨터비전": "이미지처리/컴퓨터비전",
}

# Publishers by which a column of publishers is known where a sheet has no header.
KNOWN_PUBLISHERS = (
    "한빛미디어", "길벗", "위키북스", "에이콘", "인사이트", "제이펍", "골든래빗", "영진닷컴", "비제이퍼블릭", "프리렉", "리얼타임", "생능",
    "이지스퍼블리싱", "혜지원", "로드북", "디코딩", "더 퍼블릭", "사회평론", "알에이치코리아", "코리아닷컴",
)

# Korean terms of an index and the English names that say the same.
TRANSLATIONS = {
    "벡터": "vector", "임베딩": "embedding", "토큰": "token", "프롬프트": "prompt", "에이전트": "agent", "파이프라인": "pipeline",
    "클러스터": "cluster", "인스턴스": "instance", "컨테이너": "container", "데이터": "data", "모델": "model", "서버": "server",
    "클라이언트": "client", "인터페이스": "interface", "모듈": "module", "패키지": "package", "라이브러리": "library", "프레임워크": "framework",
    "알고리즘": "algorithm", "파라미터": "parameter", "아키텍처": "architecture", "캐시": "cache", "스택": "stack", "큐": "queue",
    "노드": "node", "레이어": "layer", "배치": "batch",
}

# Words after a term that make it a mere modifier, and cues of a page that opens a chapter.
MODIFIED = ("알고리즘", "방식", "패턴", "모드", "타입", "유형", "기법", "방법", "기능", "옵션")
CHAPTER_CUES = ("학습목표", "학습 목표", "학습흐름", "학습 흐름", "핵심 개념", "핵심개념", "이 장에서 배울", "이 장의 목표", "학습 내용", "이 장에서는", "이번 장에서")

# Double passives and what stands for each, as a passive and as an active form.
PASSIVES = (
    (r"되어지", "되", "한다"),
    (r"되어\s*지고", "되고", "하고"),
    (r"쓰여지", "쓰인다", "쓴다"),
    (r"받아지", "받는다", "얻는다"),
    (r"보여지", "보인다", "본다"),
    (r"잊혀지", "잊힌다", "잊는다"),
    (r"나뉘어지", "나뉜다", "나눈다"),
)
