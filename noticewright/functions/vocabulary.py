"""Fixed values of the notice rules: vocabularies in their order, with weights where they have some."""

from __future__ import annotations

STRONG = {
    "竞赛": 5.0, "比赛": 5.0, "挑战杯": 10.0, "设计大赛": 8.0, "演讲比赛": 8.0, "技能大赛": 8.0, "创新大赛": 8.0, "创意大赛": 8.0,
    "创业计划竞赛": 10.0, "建模大赛": 8.0, "数学竞赛": 8.0, "英语竞赛": 8.0, "计算机设计大赛": 8.0, "市场调查与分析大赛": 8.0, "统计建模大赛": 8.0,
    "蓝桥杯": 10.0, "21世纪杯": 10.0, "米兰设计周": 8.0, "能源经济学术创意大赛": 8.0, "数据要素素质大赛": 8.0, "数据要素×大赛": 8.0,
    "中国国际大学生创新大赛": 10.0, "互联网+": 10.0, "全国大学生数学建模竞赛": 10.0, "全国大学生英语竞赛": 10.0, "全国大学生电子设计竞赛": 10.0,
    "全国大学生机械创新设计大赛": 10.0, "全国大学生结构设计竞赛": 10.0, "全国大学生化工设计竞赛": 10.0, "全国大学生智能汽车竞赛": 10.0, "全国大学生程序设计竞赛": 10.0,
    "全国大学生数学竞赛": 10.0, "全国大学生物理实验竞赛": 10.0, "全国大学生化学实验竞赛": 10.0, "全国大学生生命科学竞赛": 10.0, "全国大学生环境设计大赛": 10.0,
    "全国大学生工业设计大赛": 10.0, "全国大学生广告艺术大赛": 10.0, "全国大学生摄影艺术大赛": 10.0, "全国大学生书法大赛": 10.0, "全国大学生文学作品大赛": 10.0,
    "全国大学生创业大赛": 10.0, "全国大学生职业规划大赛": 10.0, "全国大学生就业创业大赛": 10.0, "全国大学生社会实践大赛": 10.0, "全国大学生志愿服务大赛": 10.0,
    "全国大学生科技作品竞赛": 10.0, "全国大学生发明创造大赛": 10.0, "全国大学生专利申请大赛": 10.0, "全国大学生知识产权竞赛": 10.0, "全国大学生法律知识竞赛": 10.0,
    "全国大学生历史知识竞赛": 10.0, "全国大学生地理知识竞赛": 10.0, "全国大学生生物知识竞赛": 10.0, "全国大学生计算机知识竞赛": 10.0, "导游风采大赛": 8.0,
    "微团课比赛": 8.0, "红色文化科普讲解": 8.0, "企业竞争模拟": 8.0, "工程实践与创新能力": 8.0, "CaTICs": 8.0, "节能减排": 8.0, "藏龙杯": 8.0,
    "浩然杯": 8.0, "导游风采": 8.0, "微团课": 8.0, "心理知识大赛": 8.0, "红色文化科普讲解案例大赛": 8.0, "经典诵读": 8.0, "写作大赛": 8.0,
    "统计建模": 8.0, "华中杯": 8.0, "创新创业大赛": 10.0, "职业规划大赛": 8.0, "企业经营模拟": 8.0, "案例分析大赛": 8.0, "辩论赛": 8.0,
    "知识竞赛": 8.0,
}

SECONDARY = {
    "选拔赛": 6.0, "校赛": 6.0, "初赛": 4.0, "决赛": 4.0, "报名": 3.0, "参赛": 3.0, "获奖": 3.0, "奖金": 3.0, "奖项": 3.0,
    "征集": 2.0, "评选": 2.0, "展示": 2.0, "活动": 2.0,
}

EXCLUDED = [
    "考试", "培训", "遴选", "招生", "转专业", "讲座", "报告", "经验分享", "公示", "文件转发", "志愿服务", "升国旗", "暑期社会实践", "团日活动", "主题团日",
    "班会", "晚讲评", "招聘", "宣讲会", "访企拓岗", "表彰", "学工", "辅导员", "班主任", "学生工作", "例会", "放假", "缴费", "樱花", "优秀学院学生会",
    "获全国", "获一等奖", "获二等奖", "获三等奖", "大赛（a类）", "大赛（a+类）", "校友返校", "庆祝荣休", "统测补考", "考生资格", "成绩等级", "补充说明", "成功晋级",
    "获奖队伍", "名单公布", "喜报", "心理委员", "心理委员培训", "培养考核", "外聘教师", "信息统计", "学籍信息", "编制", "指南", "重修课表", "重修报名", "普通话测试",
    "学籍异动", "课程补修", "免修", "选修课程", "补选", "缓考", "补考", "招募", "志愿宣讲团", "获评", "指数", "奖学金", "评选", "教学改革", "教研项目",
    "竞赛奖励", "奖励申报", "考场安排", "工作量", "拟推荐", "观看", "工作方案", "创新大赛现场赛", "教师数智教育", "智慧课程", "泛雅杯", "智慧树杯", "课创赛",
    "教学竞赛项目", "以歌传情", "唱响青春", "合唱队", "歌咏比赛", "我院团队荣获", "艺术设计学院在", "我院一团队获", "未来设计师", "全国大学生数字媒体科技作品及创意竞赛",
    "教师参加", "教学设计创新", "混合式教学设计", "同课异构", "超星杯", "学工例会", "工作例会", "会议纪要", "会议通知", "年审", "年检", "年审合格", "社团年审",
    "招生简章", "微专业", "辅修", "双学位", "召开", "部署", "总结会", "表彰会", "颁奖会", "班委会", "查寝", "查课", "招聘会", "就业服务", "心理普查",
    "心灵剧场", "心委评选", "党校", "入党积极分子", "发展对象", "预备党员", "五四评优", "评优评先", "评奖评优", "答疑会", "座谈会", "交流会", "研讨会", "论坛",
    "报告会", "部门例会", "全体会议", "专题会议", "答疑", "学术讲座", "学术报告", "教授应邀", "应邀", "暑期培训", "辅导", "考前辅导", "教师教学创新大赛",
    "辅导员素质能力大赛", "班主任基本功", "教职工运动会", "教工组",
]

TEACHERS = ["教师教学创新大赛", "辅导员素质能力大赛", "班主任基本功", "教师数智教育", "混合式教学设计", "同课异构", "泛雅杯", "智慧树杯"]
SPORTS = ["运动会", "彩虹跑", "羽毛球赛"]
STAFF = ["教职工", "教工组"]
STUDENTS = ["学生"]
TITLE_MARKS = ["赛", "杯", "大赛", "挑战杯", "蓝桥杯"]
AWARD_REPORTS = ["获全国", "获一等奖", "获二等奖", "获三等奖", "荣获", "斩获"]
FEATURES = [
    "报名截止", "参赛对象", "奖项设置", "一等奖", "二等奖", "颁发证书", "奖金", "推荐参加省赛", "推荐参加国赛", "指导老师", "评委", "答辩", "路演",
]

BONUS = ["杯", "大赛", "竞赛"]
MEETINGS = ["会议指出", "会议强调", "会议要求", "例会", "工作部署", "总结讲话", "会议总结", "会议认为"]
LECTURES = ["讲座", "学术报告", "报告会", "主讲人", "主持人", "本次讲座", "报告内容"]

#: Patterns of a veto, in order: (what is read, pattern, pattern that spares it or "", verdict).
#: "title" and "content" are as given, "text" is title and content without white space and quotes.
VETO = [
    ("title", "(荣获|斩获|获得).*(一等奖|二等奖|三等奖|金奖|银奖|铜奖)", "", False),
    ("title", "关于举办.*(竞赛|大赛|挑战赛)", "", False),
    ("title", "关于组织参加.*(竞赛|大赛|挑战赛)", "", False),
    ("title", "(藏龙杯|华中杯|统计建模).*比赛", "", False),
    ("title", "(经典诵读|写作).*大赛", "", False),
    ("title", "教师教学创新|产教融合组", "", True),
    ("title", "征集活动", "竞赛|大赛", True),
    ("title", "跬步计划|科研项目评选", "", True),
    ("title", "团日活动|主题团日", "", True),
    ("text", "(召开|举行|举办).*(学工例会|工作例会|会议|部署会|总结会)", "STRONG", True),
    ("text", "会议指出|会议强调|参会人员|会议认为|会议要求", "", True),
    ("text", "公示.*(名单|结果|合格|年审)", "", True),
    ("text", "(招生简章|微专业|辅修专业|双学位).*报名", "", True),
    ("text", "查寝|查课|晚讲评|心理健康普查", "", True),
    ("title", "召开.*(学工例会|工作例会|部门例会|全体会议|专题会议|答疑会|座谈会|交流会)", "", True),
    ("title", "^(学工例会|工作例会|部门例会|转专业.*答疑会|答疑会)", "", True),
    ("title", "^召开.*会议", "STRONG", True),
    ("title", "转专业.*(答疑|座谈会)|(答疑|座谈会).*转专业", "", True),
    ("title", "学工例会", "", True),
    ("title", "讲座|学术报告|报告会|教授应邀|应邀.*讲座", "竞赛|大赛|挑战杯|设计大赛|创新大赛|创业大赛", True),
    ("title", "培训|暑期培训|辅导班|考前培训", "竞赛|大赛|挑战杯|选拔赛", True),
]
