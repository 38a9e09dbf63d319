"""Word lists and patterns of the style and lexical operators."""

from __future__ import annotations

#: English function words that are no vocabulary.
STOP_WORDS = """
a an the i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers
herself it its itself they them their theirs themselves what which who whom this that these those in on at to for of
with by from as into through during before after above below between under over out off down up about against within
without along around among and or but nor so yet both either neither not only than when while if then else because
although though unless since until is am are was were be been being have has had having do does did doing will would
could should may might must shall can need dare ought very just also now here there where how why all each every any
some no more most other such own same too few many much less least further once again et al ie eg cf vs etc pp vol fig
table eq eqs ref refs one two three four five six seven eight nine ten first second third
""".split()

#: Formulaic transitions.
TRANSITIONS_ZH = "值得注意的是 需要指出的是 众所周知 不言而喻 毋庸置疑 显而易见 事实上 实际上 总的来说 综上所述 总而言之 由此可见 由此可知 不难发现 可以看出 首先 其次 然后 接下来 最后 一方面 另一方面 与此同时 除此之外 此外 因此 因而 从而 进而 有鉴于此 在此基础上 至关重要 极其重要 十分重要 深入探讨 深入研究 全面分析 系统分析 深刻影响 深远影响 重要意义".split()
TRANSITIONS_EN = [
    "It is worth noting that", "It should be noted that", "Notably", "Indeed", "In fact", "To summarize", "In conclusion", "To sum up", "All in all", "Firstly", "Secondly", "Thirdly", "Finally", "Furthermore", "Moreover", "Additionally", "Therefore", "Thus", "Hence", "Consequently", "As a result",
    "extremely important", "crucially important", "highly significant", "plays a crucial role", "plays a vital role", "of paramount importance",
]
#: Words typical of generated Chinese prose.
AI_WORDS_ZH = "首先 其次 然后 最后 综上所述 总而言之 值得注意的是 需要指出的是 与此同时 除此之外 一方面 另一方面 此外 因此 由此可见 至关重要 极其重要 十分重要 深入探讨 全面分析 系统性 全面性 深度 广度 精准 高效 创新性 突破性 核心 关键 重要意义 深远影响 赋能 抓手 闭环 底层逻辑 颗粒度 链路 打通 打造 廻建 賭道 穿透 点位 进化 融合 嵌入 视角 维度 方法论 生态 有鉴于此 在此基础上 起着重要作用 不可或缺 应运而生 与时俱进 日益增长 不断加强 持续改进 稳步推进 切实提高 充分发挥 未来可期 前景广阔 蓬勃发展 方兴未艾 大有可为 潜力无限 大放异彩 引领风骚 开创新局 再创辉煌 续写篇章 谱写新篇 实际上 事实上 总的来说 从某种程度上 在一定程度上 不言而喻 比如说 也就是说 换句话说 进一步来说 与之相对 与之相比 相较之下 由此可知 不难发现 范式 框架 体系 机制 模式 路径 策略 方案 举措 对策 思路 思维 理念 精神 内涵 外延".split()
#: Passive markers, passive patterns and sentence templates.
PASSIVE_MARKERS_ZH = ["被", "由...所", "受到", "得到", "获得", "遭到"]
PASSIVE_PATTERNS_ZH = ["被.*所", "由.*所", "受到.*的", "得到.*的"]
TEMPLATES_ZH = ["起着.*作用", "具有.*意义", "对于.*而言", "从.*角度来看", "在.*方面", "通过.*可以", "随着.*的发展"]
#: Openings that are kept as a sentence scaffold, by priority.
SCAFFOLDS_EN = [
    "in this paper", "in this study", "in this work", "in this article", "overall", "taken together", "consistent with", "in line with", "in particular", "specifically", "to this end",
    "more generally", "in addition", "moreover", "finally", "we examine", "we study", "we investigate", "we find", "we show", "we document", "we provide",
]
