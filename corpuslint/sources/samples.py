"""Query corpus: every document gets one of fourteen code templates in front of its text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .files import files_from_table, spread

# File name ending and code per template.
TEMPLATES = [
    ('.py', r'''import os, pickle, random, subprocess
from models import User
def load(path, tags=[]):
    data = pickle.load(open(path))
    for row in data:
        for col in row:
            while col:
                out += "x"
                cur = db.query(row.id)
                hit = row.id
                m = re.search("a", col)
    copy = tags[:]
    return data
    print("never")'''),
    ('.py', r'''def run(cmd):
    try:
        eval(cmd)
        os.system(cmd)
        subprocess.call(cmd, shell=True)
        cursor.execute("select " + cmd)
    except:
        pass
    x = yaml.load(cmd)
    h = md5(cmd)
    return requests.get("https://api.example.com/v1", verify=False)'''),
    ('.js', r'''var total = 0;
// TODO tidy up
element.innerHTML = total;
document.write(total);
console.log("a" + "b" + "c");
const api = require("express");
module.exports = function go() { return fetch("../data/file.json"); };'''),
    ('.py', r'''"""Module with documentation."""
# the thing
MAX_SIZE = 4096
class Store:
    def add(self, item):
        """Add one item."""
        global CACHE
        if item in CACHE:
            return True
        flag = item == True
        token = random.choice(item)
        add(item); add(item); add(item)
        a.append(1); a.append(6); a.append(7); a.append(8); a.append(9); a.append(150)
        n = len(list(range(150)))
@app.route("/items")
def items():
    return [a for a in b for c in d for e in f]
github_token = "x"'''),
    ('.java', r'''package demo.app;
import org.springframework.stereotype.Service;
import java.util.Optional;
@Service
public class Job extends Base implements Runnable {
    @Autowired private Repo repo;
    Optional<String> f() { synchronized (this) { return repo.all().stream().map(x -> x.n).findFirst(); } }
    void g() { try { f(); } catch (Exception e) { System.out.println("password: " + e); } }
}'''),
    ('pom.xml', r'''<project><dependencies>
<dependency><groupId>org.springframework.boot</groupId><artifactId>spring-boot-starter-web</artifactId></dependency>
<dependency><groupId>org.projectlombok</groupId><artifactId>lombok</artifactId></dependency>
</dependencies><build><plugins><plugin><artifactId>maven-compiler-plugin</artifactId></plugin></plugins></build></project>'''),
    ('.ts', r'''interface Item { name: string }
type Key = keyof Item;
headers = "Access-Control-Allow-Origin: *";
page = '<form action="/save">';
enum Mode { A, B }'''),
    ('README.md', r'''Some words without a heading
usage: see below'''),
    ('.py', r'''from a import b
DEFAULT_PATH = "/etc/app.conf"
# the end
# ok
# see x
# FIXME HACK XXX BUG
def many(a):
    exec(a)
    os.popen(a) | os.path
    f = os.path.join(a + b)
    g = open(a % "%s")
    conn = db.connect(a)
    cursor.execute("%s" % a, "%s" % b)
    cursor.execute(f"select {a}")
    cursor.execute("x {}".format(a))
    k = {"password": "secret1", "api_key" : "k"}
    c = DES.new(a); r = RC4(a); e = Cipher.AES_MODE_ECB; s = sha1(a)
    pickle.loads(a); marshal.load(a); jsonpickle.decode(a)
    yaml.load(a, Loader=yaml.Loader); yaml.unsafe_load(a)
    t = ET.parse(a, parser=None); import defusedxml
    n = random.random() + random.randint(1, 777)
    commands.getstatusoutput("ls | sh")
    eval(params)
    try: pass
    except ValueError: raise
    for q in a:
        Q.find(q); Q.select(q); Q.filter(q)
    v = "a" +"b+"
    w = [x for x in a for y in x if x if y if q]
def odd(x): int: "text"
key = "-----BEGIN PRIVATE KEY-----"
@router.get("/x")
def __repr__(self): print("r")'''),
    ('.js', r'''const url = `${host}/items`;
node.dangerouslySetInnerHTML = {v: 1};
render(x.innerHTML);
spawn("ls", {shell = True});
allowedOrigins = ["*"]
if (a == b) { helperName(MyClassName, snake_name); }
@Api.Get("/x")
from django.utils.html.escape'''),
    ('.py', r'''def total_of(rows):
    total = 0
    step_1 = total + 1
    step_2 = total + 2
    step_3 = total + 3
    step_4 = total + 4
    step_5 = total + 5
    step_6 = total + 6
    step_7 = total + 7
    step_8 = total + 8
    step_9 = total + 9
    step_10 = total + 10
    step_11 = total + 11
    step_12 = total + 12
    step_13 = total + 13
    step_14 = total + 14
    step_15 = total + 15
    step_16 = total + 16
    step_17 = total + 17
    step_18 = total + 18
    step_19 = total + 19
    step_20 = total + 20
    step_21 = total + 21
    step_22 = total + 22
    step_23 = total + 23
    step_24 = total + 24
    step_25 = total + 25
    step_26 = total + 26
    step_27 = total + 27
    step_28 = total + 28
    step_29 = total + 29
    step_30 = total + 30
    step_31 = total + 31
    step_32 = total + 32
    step_33 = total + 33
    step_34 = total + 34
    step_35 = total + 35
    step_36 = total + 36
    step_37 = total + 37
    step_38 = total + 38
    step_39 = total + 39
    step_40 = total + 40
    step_41 = total + 41
    step_42 = total + 42
    step_43 = total + 43
    step_44 = total + 44
    step_45 = total + 45
    step_46 = total + 46
    step_47 = total + 47
    step_48 = total + 48
    step_49 = total + 49
    step_50 = total + 50
    step_51 = total + 51
    step_52 = total + 52
    return total
async def short(a):
    return total_of(a) or total_of(a) and total_of([a])
class Deep:
    def walk(self, tree):
        for a in tree:
            for b in a:
                if b:
                    while b:
                        b = b.next'''),
    ('.java', r'''package demo.web;
import org.springframework.web.bind.annotation.RestController;
import org.springframework.data.jpa.repository.JpaRepository;
import lombok.Data;
@Data @Entity @Table(name = "orders")
public class OrderRow { @Id private Long id; @NotNull private String name; }
@RestController
class OrderApi { @GetMapping("/orders/{id}") ResponseEntity<OrderRow> one(@PathVariable Long id) { return null; } }
interface Orders extends JpaRepository<OrderRow, Long> { }'''),
    ('application.yml', r'''server:
  port: 8080
spring:
  datasource:
    url: jdbc:postgresql://db/orders
  redis:
    host: cache'''),
    ('application.properties', r'''spring.application.name=orders
spring.datasource.url=jdbc:mysql://db/orders'''),
]


def template_path(ending: str) -> str:
    """``pom.xml`` and ``README.md`` are whole names, the others are suffixes."""
    return ending if ending.startswith(".") else f"/{ending}"


def code_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole ``documents`` table as source files."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    kind = F.col("doc_id") % len(TEMPLATES)
    ending, code = F.lit(None).cast("string"), F.lit(None).cast("string")
    for i, (name, body) in enumerate(TEMPLATES):
        ending = F.when(kind == i, template_path(name)).otherwise(ending)
        code = F.when(kind == i, body).otherwise(code)
    path = F.concat(
        F.lit("src/m"), (F.col("doc_id") % 7).cast("string"),
        F.lit("/f"), F.col("doc_id").cast("string"), ending,
    )
    return spread(files_from_table(
        documents, path, F.concat(code, F.lit("\n"), F.col("text")), F.col("doc_id")
    ))


def document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plain ``documents`` table, one text file per document."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    path = F.concat(F.lit("docs/d"), F.col("doc_id").cast("string"), F.lit(".py"))
    return spread(files_from_table(documents, path, F.col("text"), F.col("doc_id")))


def page_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``pages`` table as script files, so that the markup checks read it."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html")
    path = F.concat(F.lit("pages/p"), F.col("page_id").cast("string"), F.lit(".js"))
    return spread(files_from_table(pages, path, F.col("html"), F.col("page_id")))
