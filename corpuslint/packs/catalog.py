"""What every check is called, how severe it is and what it says.

Texts with ``{line}``, ``{count}`` and ``{what}`` places are filled per finding, ``{limit}``
from the configured limits.
"""

from __future__ import annotations

from typing import NamedTuple

from .probes import DANGEROUS


class Check(NamedTuple):
    check_id: str
    category: str
    severity: str
    rule_id: str
    name: str
    message: str
    suggestion: str


# Identifiers, severities and report texts.
QUALITY = [
    Check("QUAL001", "code_quality", "medium", "max-line-length", "代码行过长",
          "行 {line} 长度 ({count} 字符) 超过限制 ({limit} 字符)",
          "建议将行长度控制在 {limit} 字符以内"),
    Check("QUAL002", "code_quality", "medium", "max-function-length", "函数过长",
          "函数 '{what}' 长度 ({count} 行) 超过建议限制 ({limit} 行)",
          "考虑将函数拆分为更小的、单一职责的函数"),
    Check("QUAL003", "code_quality", "info", "code-duplication", "可能存在代码重复",
          "检测到 {count} 行可能重复的代码", "考虑将重复代码提取为独立函数或使用继承/组合模式"),
    Check("QUAL004", "code_quality", "medium", "no-empty-except", "空的异常捕获",
          "行 {line} 存在空的异常捕获块，可能隐藏了重要错误",
          "在异常处理中至少记录日志，或处理具体的异常类型"),
    Check("QUAL005", "code_quality", "info", "no-hardcoded-values", "检测到{what}",
          "行 {line}: {what}", "考虑将 {what} 移至配置文件或环境变量"),
    Check("QUAL006", "code_quality", "info", "consistent-naming", "命名风格不一致",
          "代码中混合使用了不同的命名风格（snake_case, camelCase, PascalCase）",
          "建议统一使用一种命名风格，如 PEP 8 推荐的 snake_case"),
    Check("QUAL007", "code_quality", "medium", "max-nesting", "代码嵌套过深",
          "行 {line} 嵌套层级 ({count}) 超过建议限制 (4)",
          "考虑使用早期返回、提取函数或使用卫语句减少嵌套"),
    Check("QUAL008", "code_quality", "info", "no-magic-numbers", "使用魔法数字",
          "行 {line}: 数字 {what} 看起来是魔法数字",
          "考虑定义一个具有描述性名称的常量，如 MAX_{what} = {what}"),
    Check("QUAL009", "code_quality", "info", "no-unreachable", "可能的死代码",
          "行 {line} 在 return 语句之后，可能是无法到达的死代码", "删除无法到达的代码或调整函数逻辑"),
]

BEST_PRACTICES = [
    Check("BP001", "best_practices", "high", "no-bare-except", "使用裸except子句",
          "行 {line}: 使用了 except: 而不是 except Exception:",
          "明确指定要捕获的异常类型，避免捕获 KeyboardInterrupt 等系统异常"),
    Check("BP002", "best_practices", "info", "reraise-exception", "异常重新抛出",
          "行 {line}: 检测到异常被捕获后直接重新抛出", "考虑使用 raise from 或让异常自然传播"),
    Check("BP003", "best_practices", "medium", "use-context-manager", "未使用上下文管理器",
          "代码中存在未使用 with 语句的文件操作，可能导致资源泄漏", "使用 with open() 语句确保文件正确关闭"),
    Check("BP004", "best_practices", "medium", "resource-cleanup", "可能存在资源泄漏",
          "检测到连接/资源操作，可能未正确释放资源", "确保所有资源在使用后被正确关闭，或使用上下文管理器"),
    Check("BP005", "best_practices", "info", "add-return-type", "缺少返回类型注解",
          "函数 '{what}' 缺少返回类型注解", "添加类型注解以提高代码可读性和类型检查支持"),
    Check("BP006", "best_practices", "info", "add-parameter-types", "参数缺少类型提示",
          "函数 '{what}' 的参数缺少类型提示", "为所有参数添加类型注解"),
    Check("BP007", "best_practices", "low", "add-docstring", "缺少文档字符串",
          "公共函数 '{what}' 缺少文档字符串", "为所有公共函数添加描述性文档字符串，说明功能、参数和返回值"),
    Check("BP008", "best_practices", "low", "imports-at-top", "导入语句位置不当",
          "import语句应该放在文件顶部",
          "将所有import语句移到文件顶部，标准库优先，然后是第三方库，最后是本地模块"),
    Check("BP009", "best_practices", "high", "no-circular-imports", "可能存在循环导入",
          "可能存在循环导入问题：模块 '{what}'", "重构代码以避免循环导入，可使用延迟导入或重新组织模块结构"),
    Check("BP010", "best_practices", "info", "constant-naming", "常量未使用大写命名",
          "常量 '{what}' 使用了大写命名但可能被当作普通变量处理",
          "确保常量定义在大写的同时，也放在模块顶部或专门的常量文件中"),
    Check("BP011", "best_practices", "critical", "no-mutable-defaults", "使用可变对象作为默认参数",
          "行 {line}: 使用可变对象（列表或字典）作为函数默认参数",
          "使用 None 作为默认值，然后在函数内部初始化空列表/字典"),
    Check("BP012", "best_practices", "info", "complex-comprehension", "过于复杂的列表推导式",
          "行 {line}: 检测到可能过于复杂的列表推导式", "考虑拆分为多个步骤或使用普通循环以提高可读性"),
    Check("BP013", "best_practices", "info", "use-logging", "使用print语句",
          "行 {line}: 检测到使用print进行输出", "使用logging模块进行日志输出，便于控制日志级别"),
    Check("BP014", "best_practices", "info", "no-bool-comparison", "使用 == True/False 比较",
          "检测到使用 == True 或 == False 进行比较", "直接使用 if condition: 而不是 if condition == True:"),
    Check("BP015", "best_practices", "info", "define-all", "缺少__all__定义",
          "模块定义了函数但没有 __all__ 列表", "定义 __all__ 列表以明确模块的公共API"),
    Check("BP016", "best_practices", "info", "no-var", "使用var关键字",
          "检测到使用var声明变量", "使用let或const替代var，const用于不变的值，let用于会变化的值"),
    Check("BP017", "best_practices", "medium", "use-strict-equality", "使用松散相等比较",
          "检测到使用 == 或 != 进行比较", "使用 === 或 !== 进行严格相等比较，避免类型转换带来的意外行为"),
    Check("BP018", "best_practices", "info", "no-console-log", "使用console.log",
          "检测到使用console.log进行调试", "使用专业的日志库如loglevel或winston，便于控制日志级别"),
]

PERFORMANCE = [
    Check("PERF001", "performance", "medium", "deep-loop-nesting", "嵌套过深的循环",
          "行 {line}: 检测到 {count} 层嵌套循环", "深层嵌套循环可能影响性能，考虑重构为更高效的算法"),
    Check("PERF002", "performance", "medium", "string-concat-in-loop", "循环中拼接字符串",
          "行 {line}: 在循环中使用字符串拼接可能效率低下", "使用列表+join()或生成器表达式代替循环拼接"),
    Check("PERF003", "performance", "info", "multiple-string-concat", "使用+连接多个字符串",
          "检测到使用+运算符连接多个字符串", "使用f-string或join()方法更高效"),
    Check("PERF004", "performance", "info", "unnecessary-copy", "不必要的列表拷贝",
          "行 {line}: 创建了 '{what}' 的浅拷贝", "如果不需要副本，考虑直接引用原列表或使用切片拷贝的替代方案"),
    Check("PERF005", "performance", "info", "inefficient-data-structure", "可能存在低效数据结构使用",
          "代码中多次使用append，可能适合使用集合(set)进行快速查找",
          "如果主要进行成员检查操作，考虑使用set代替list"),
    Check("PERF006", "performance", "info", "membership-check", "成员检查可能低效",
          "检测到使用 'in' 进行成员检查", "如果列表较大，考虑使用set进行O(1)查找"),
    Check("PERF007", "performance", "info", "avoid-globals", "使用全局变量",
          "行 {line}: 检测到全局变量声明", "全局变量可能影响性能和代码可维护性，考虑使用参数传递或类封装"),
    Check("PERF008", "performance", "low", "cache-attribute", "重复的属性访问",
          "行 {line}: 检测到重复的属性访问，可能适合缓存", "将重复访问的属性缓存在局部变量中"),
    Check("PERF009", "performance", "high", "regex-in-loop", "循环中编译正则表达式",
          "行 {line}: 在循环中重复编译正则表达式", "将正则表达式编译移到循环外部"),
    Check("PERF010", "performance", "high", "n-plus-one", "可能的N+1查询问题",
          "行 {line}: 在循环中执行数据库查询", "考虑使用批量查询或预加载(JOIN/SELECT IN)来减少查询次数"),
    Check("PERF011", "performance", "info", "unnecessary-conversion", "不必要的类型转换",
          "使用len(list(range(...)))可以简化为range(...)的直接使用", "避免不必要的类型转换"),
    Check("PERF012", "performance", "info", "cacheable-function", "可以添加缓存的函数",
          "函数 '{what}' 被调用 {count} 次，可能是纯函数", "考虑使用@lru_cache装饰器缓存函数结果"),
]

DOCUMENTATION = [
    Check("DOC001", "documentation", "low", "module-docstring", "缺少模块文档",
          "模块缺少文档字符串", "在文件顶部添加模块级文档字符串，描述模块的功能和用途"),
    Check("DOC002", "documentation", "low", "function-docstring", "函数缺少文档",
          "函数 '{what}' 缺少文档字符串", "为 '{what}' 添加文档字符串，说明功能、参数和返回值"),
    Check("DOC003", "documentation", "info", "document-args", "文档缺少参数说明",
          "函数 '{what}' 的文档缺少参数说明", "在 '{what}' 的文档中添加 Args 或参数说明"),
    Check("DOC004", "documentation", "info", "document-return", "文档缺少返回值说明",
          "函数 '{what}' 指定了返回类型但文档缺少返回说明", "在 '{what}' 的文档中添加 Returns 说明"),
    Check("DOC005", "documentation", "low", "class-docstring", "类缺少文档",
          "类 '{what}' 缺少文档字符串", "为 '{what}' 添加文档字符串，描述类的功能和用法"),
    Check("DOC006", "documentation", "info", "meaningless-comment", "无意义注释",
          "行 {line}: 存在无意义的注释", "删除无意义的注释，或用有意义的说明替代"),
    Check("DOC007", "documentation", "info", "todo-comment", "存在{what}",
          "行 {line}: 检测到{what}标记", "考虑处理此{what}标记，或添加更详细的说明和JIRA/Issue链接"),
    Check("DOC008", "documentation", "low", "api-documentation", "{what}缺少API文档",
          "行 {line}: {what}缺少API文档", "为{what}添加API文档，说明端点功能、参数和响应格式"),
    Check("DOC009", "documentation", "info", "readme-quality", "README质量可改进",
          "README缺少以下内容: {what}", "完善README以提高项目可维护性和可发现性"),
]

SECURITY = [
    Check("SEC010", "security", "critical", "sql-injection", "潜在的SQL注入风险",
          "行 {line}: {what}", "使用参数化查询（Prepared Statements）或ORM框架"),
    Check("SEC011", "security", "high", "xss-vulnerability", "潜在的XSS风险",
          "行 {line}: {what}", "对用户输入进行HTML转义，使用安全的DOM操作API"),
    Check("SEC012", "security", "critical", "command-injection", "潜在的命令注入风险",
          "行 {line}: {what}", "避免shell=True，使用参数列表而非字符串"),
    Check("SEC013", "security", "critical", "credential-exposure", "敏感信息泄露风险",
          "行 {line}: {what}", "将敏感信息移至环境变量或安全的密钥管理服务"),
    Check("SEC014", "security", "medium", "insecure-random", "不安全的随机数生成",
          "行 {line}: {what}", "用于安全目的时使用secrets模块或os.urandom()"),
    Check("SEC015", "security", "high", "weak-cryptography", "使用弱加密算法",
          "行 {line}: {what}", "使用SHA-256/SHA-512进行哈希，AES进行加密"),
    Check("SEC016", "security", "medium", "path-traversal", "路径遍历风险",
          "行 {line}: {what}", "对用户提供的路径进行验证和规范化"),
    Check("SEC017", "security", "high", "insecure-deserialization", "不安全的反序列化",
          "行 {line}: {what}", "使用JSON代替，或验证/签名反序列化数据"),
    Check("SEC018", "security", "high", "xxe-vulnerability", "可能的XXE漏洞",
          "行 {line}: {what}", "禁用外部实体，使用安全的XML解析器配置"),
    Check("SEC019", "security", "medium", "csrf-protection", "可能缺少CSRF保护",
          "检测到表单但未发现CSRF保护机制", "为所有表单添加CSRF令牌验证"),
    Check("SEC020", "security", "medium", "insecure-cors", "CORS配置过于宽松",
          "行 {line}: {what}", "限制允许的来源，避免使用通配符*"),
]

SKILL_FINDINGS = [
    Check("SKILL001", "professional", "info", "", "检测到编程语言", "识别到语言: {what}", ""),
    Check("SKILL002", "professional", "info", "", "检测到框架/库", "识别到框架: {what}", ""),
    Check("SKILL003", "professional", "info", "", "检测到架构模式", "识别到架构模式: {what}", ""),
    Check("SKILL004", "professional", "info", "", "检测到DevOps技能", "识别到DevOps技能: {what}", ""),
]

JAVA = [
    Check("JAVA001", "professional", "info", "", "Maven项目分析", "检测到 {count} 个Maven依赖", ""),
    Check("JAVA010", "professional", "info", "", "Java包结构", "包名: {what}", ""),
    Check("JAVA020", "professional", "info", "thread-safety", "线程同步检测",
          "代码中使用了synchronized关键字", "确保正确使用并发控制，考虑使用java.util.concurrent包中的高级工具"),
    Check("JAVA021", "professional", "info", "stream-api", "Stream API使用",
          "检测到使用Java Stream API", "Stream API可以提高代码可读性，但注意不要过度使用"),
    Check("JAVA022", "professional", "info", "optional-usage", "Optional使用",
          "检测到使用Optional避免空指针", "Good! 使用Optional是处理空值的现代方式"),
    Check("JAVA023", "professional", "medium", "exception-handling", "异常处理",
          "检测到捕获Exception", "尽可能捕获具体异常类型，避免捕获过于宽泛的Exception"),
    Check("JAVA024", "professional", "info", "lombok-usage", "Lombok使用",
          "检测到使用Lombok简化代码", "Lombok可以减少样板代码，但注意IDE支持"),
]

# The SEC001 family comes from the table of dangerous constructs.
DANGEROUS_CHECKS = [
    Check(f"SEC001-{name}", "security", severity, f"dangerous-{name}",
          f"使用危险函数: {name}", "行 {line}: {what}", suggestion)
    for name, _, severity, suggestion in DANGEROUS
]
ALL = [
    *QUALITY, *BEST_PRACTICES, *DANGEROUS_CHECKS, *SECURITY, *PERFORMANCE, *DOCUMENTATION,
    *SKILL_FINDINGS, *JAVA,
]

# Repair templates and explanations shown with the place of a finding.
FIXES = {
    "QUAL001": (
        "# 使用反斜杠或括号进行换行\nlong_expression = (\n    first_part +\n    second_part +\n    third_part\n)",
        "将长行拆分为多行，使用括号或反斜杠续行可以提高代码可读性。"),
    "QUAL002": (
        "# 将大函数拆分为多个小函数\ndef main_function():\n    data = fetch_data()\n"
        "    processed = process_data(data)\n    return format_output(processed)",
        "将大函数拆分为多个小函数，每个函数只做一件事，提高代码可维护性。"),
    "QUAL004": (
        "try:\n    # 你的代码\nexcept SpecificException as e:\n"
        '    logger.error(f"Error occurred: {e}")\n    raise  # 或添加适当的错误处理',
        "空的异常处理会隐藏错误。应该记录日志或进行适当的错误处理。"),
    "SEC001-eval": (
        "# 避免使用 eval，使用 ast.literal_eval\nimport ast\n\ndef safe_eval(expr):\n"
        "    return ast.literal_eval(expr)",
        "eval() 可以执行任意代码，存在严重的安全风险。使用 ast.literal_eval() 解析字面量。"),
    "SEC010": (
        '# 使用参数化查询\ncursor.execute(\n    "SELECT * FROM users WHERE id = %s",\n    (user_id,)\n)',
        "字符串拼接SQL容易受到注入攻击。使用参数化查询可以防止SQL注入。"),
    "SEC011": (
        "# 对用户输入进行转义\nfrom html import escape\n\nsafe_content = escape(user_input)\n"
        "element.textContent = safe_content",
        "直接插入HTML可能导致跨站脚本攻击。对用户输入进行HTML转义。"),
    "SEC012": (
        "# 避免 shell=True，使用参数列表\nsubprocess.run(\n"
        '    ["ls", "-la", directory],\n    shell=False\n)',
        "shell=True 和字符串拼接命令可能导致命令注入。使用参数列表。"),
    "BP001": (
        "try:\n    # 你的代码\nexcept Exception as e:\n    # 处理特定异常\n"
        '    raise ValueError("具体错误信息") from e',
        "捕获所有异常可能隐藏重要错误。应该捕获特定异常类型。"),
    "BP011": (
        "def func(data=None):\n    if data is None:\n        data = []  # 使用 None 作为默认值\n"
        "    data.append(1)\n    return data",
        "使用可变对象作为默认参数可能导致意外修改。使用 None 并在函数内初始化。"),
}
NO_FIX = "请参考相关文档进行修复"
FIX_LAYOUT = "问题位置:\n```python\n{context}\n```\n\n推荐修复:\n```python\n{template}\n```\n\n修复说明:\n{why}"
