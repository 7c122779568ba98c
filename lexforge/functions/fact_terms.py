"""Term lists of rule-based facts, as data."""

# Tokens that type a sentence (the first type that has one wins), names of entities, and their patterns.

CLAIM_TOKENS = {
    "problem": ["问题", "挑战", "不足", "难以", "瓶颈"],
    "method": ["方法", "算法", "模型", "框架", "机制", "设计", "构建"],
    "contribution": ["提出", "贡献", "创新", "研究内容", "主要贡献"],
    "result": ["实验", "结果", "优于", "提升", "降低", "验证"],
    "limitation": ["局限", "不足", "限制", "未来工作", "展望"],
}
ENTITY_PATTERNS = {
    "method": r"[一-鿿A-Za-z0-9_-]{2,24}(?:方法|算法|模型|框架|机制)",
    "system": r"[一-鿿A-Za-z0-9_-]{2,24}(?:系统|平台|模块)",
}
KNOWN_ENTITIES = {
    "task": ["任务规划", "任务分配", "任务分解", "协同调度", "工具调用", "路径规划"],
    "scenario": ["多智能体", "服务机器人", "动态环境", "开放环境", "真实场景"],
    "metric": ["任务完成率", "响应时间", "负载均衡", "成功率", "通信开销", "计算开销", "鲁棒性"],
    "model": ["大语言模型", "动作编码器", "技能库"],
}
NODES, CLAIM_CONFIDENCE, SUPPORT_CONFIDENCE, CITES_CONFIDENCE, CITATION_CONFIDENCE = 24, 0.58, 0.62, 0.72, 0.6
