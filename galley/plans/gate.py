"""Sentences that the rules of proofreading are held against."""

# Fixed values: (sentence, type of the slip in it, where it is); None where a sentence is clean.
SENTENCES = (
    ("이 책을를 처음부터 끝까지 차분히 읽어보세요.", "오탈자", "을를"),
    ("늦잠을 잔 학생이가 서둘러 교실로 들어왔다.", "오탈자", "이가"),
    ("그는은 이미 모든 사정을 훤히 알고 있었다.", "오탈자", "는은"),
    ("사과와과 배를 곁들여 아침으로 다 같이 먹었다.", "오탈자", "와과"),
    ("학교에서서 어제 새로운 내용을 많이 배웠다.", "오탈자", "에서서"),
    ("분기 보고서가 오늘 오후에 마침내 완성되어지다.", "이중수동", "되어지"),
    ("개정된 규칙이 현장에 곧바로 적용되어지고 있다.", "이중수동", "되어지고"),
    ("이 글은 요즘 여러 매체에서 많이 쓰여지고 있다.", "이중수동", "쓰여지"),
    ("그 제안이 위원회 심사에서 순조롭게 받아지다.", "이중수동", "받아지"),
    ("숨겨진 진실이 시간이 지나며 서서히 보여지다.", "이중수동", "보여지"),
    ("그 사건은 사람들 기억에서 쉽게 잊혀지지 않는다.", "이중수동", "잊혀지"),
    ("참가자들이 실력에 따라 두 그룹으로 나뉘어지다.", "이중수동", "나뉘어지"),
    ("좋은 컨텐츠를 오랫동안 꾸준히 만들어야 한다.", "외래어표기오류", "컨텐츠"),
    ("도착한 메세지를 지금 바로 확인하세요.", "외래어표기오류", "메세지"),
    ("요즘 시대에는 리더쉽이 무엇보다 중요하다고 한다.", "외래어표기오류", "리더쉽"),
    ("복잡한 워크플로우를 도구로 체계적으로 관리하라.", "외래어표기오류", "워크플로우"),
    ("이 문제는 조금만 노력하면 해결할 수가 있다.", "중복군더더기", "할 수가 있"),
    ("이번 안건은 매우 매우 중요한 사안으로 다뤄졌다.", "중복군더더기", "매우 매우"),
    ("주말에 친구와 함께 같이 동네 공원에 다녀왔다.", "중복군더더기", "함께 같이"),
    ("이것이라고 하는 것은 결코 사실이 아니라고 밝혀졌다.", "중복군더더기", "라고 하는 것은"),
    ("교육에 있어서 가장 중요한 것은 꾸준한 실천이다.", "일본식표현", "교육에 있어서"),
    ("시스템에서의 처리 속도를 지금보다 더 높여야 한다.", "번역체", "시스템에서의 "),
    ("사용자로부터의 피드백이 제품 개선에 반드시 필요하다.", "번역체", "사용자로부터의 "),
    ("결론적으로 이 방법이 현재로서는 가장 최선이다.", "AI투", "결론적으로"),
    ("이 책의 예제를 하나씩 직접 따라하기 바랍니다.", "맞춤법", "따라하기"),
    ("그럴려고 했지만 사정이 생겨 결국 실패했다.", "맞춤법", "그럴려고"),
    ("첨부된 파일을 내려 받아서 곧바로 실행하세요.", "띄어쓰기", "내려 받"),
    ("어제 말씀하신 그 일은 결국 어떻게 됬어요?", "맞춤법", "됬"),
    ("나의 바램은 언젠가 좋은 책을 쓰는 것이다.", "맞춤법", "바램"),
    ("그것이 바로 오랜 노력이 낳은 그의 만듬이었다.", "맞춤법", "만듬"),
    ("이 책을 처음부터 끝까지 차분히 읽어보세요.", None, None),
    ("늦잠을 잔 학생이 서둘러 교실로 들어왔다.", None, None),
    ("좋은 콘텐츠를 오랫동안 꾸준히 만들어야 한다.", None, None),
    ("도착한 메시지를 지금 바로 확인하세요.", None, None),
    ("이 문제는 조금만 노력하면 해결할 수 있다.", None, None),
    ("교육에서 가장 중요한 것은 꾸준한 실천이다.", None, None),
    ("이 책의 예제를 하나씩 직접 따라 하기 바랍니다.", None, None),
    ("그러려고 했지만 사정이 생겨 결국 실패했다.", None, None),
    ("어제 말씀하신 그 일은 결국 어떻게 됐어요?", None, None),
    ("나는 언젠가 좋은 책을 한 권 쓰고 싶다.", None, None),
)
